import random

import pytest
from pyspark.sql import functions as F

from runout.llm import url_filter as U
from runout.llm.queries import URL_RULES


def brute(url, rules, listed):
    at = url.find("://") if url else -1
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    verdict = best.verdict if best else "block" if host in listed else "allow"
    return host, path, best.key if best else None, verdict


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://COM/x", "http://xcom/", "http://a.com/?q#f",
    "http://www.example.com/en/a", "http://WWW.Example.com/en/", "http://a.www.example.com/en/x?y", "http://example.com/en",
    "http://m.example.com/en/1", "http://x.net/es/1", "http://x.net/de/1", "http://net/fr/", "http://bad.net/de", "http://bad.net?x",
    "ftp://u:p@bad.org:80/x", "http://bad.org#/en/", "a://b://c.com/", "http://ÄB.org/É", "http://a..com/x", "http://bad.org\n/x",
    "http://" + "a." * 5000 + "com/" + "x" * 50_000, "http://bad.org", "http://bad.org",
]


@pytest.mark.parametrize("rules", [URL_RULES, ()])
def test_verdicts_against_brute_force(spark, rules):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://bad.org/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([("bad.org",), ("bad.net",), ("bad.org",), ("unseen.org",), (None,)], "h string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, rules, listed).collect()}
    assert got == {i: brute(u, rules, {"bad.org", "bad.net"}) for i, u, *_ in rows}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    listed = spark.createDataFrame([], "h string")
    assert U.judge_urls(pages.where("false"), URL_RULES, listed).count() == 0
    assert U.judge_urls(pages, URL_RULES, listed).first().verdict == "allow"


@pytest.mark.parametrize(("n_in", "n_out"), [(0, 50), (40, 0), (30, 3000), (1500, 1500), (2000, 100), (1, 4000)])
def test_cascade_is_exact_over_its_universe(spark, n_in, n_out):
    rng = random.Random(n_in)
    keys = [f"k{rng.getrandbits(60):x}" for _ in range(n_in + n_out)]
    frame = lambda ks: spark.createDataFrame([(k,) for k in [*ks, None]], "key string")
    cascade = U.build_cascade(frame([*keys, *keys[:5]]), frame(keys[:n_in]))
    found = {r.key for r in frame(keys).where(cascade.contains(F.col("key"))).collect()}
    assert found == set(keys[:n_in])
    assert bool(cascade.levels) == bool(n_in)
    if n_in == 30:
        assert len(cascade.levels) > 1  # some unlisted keys pass level 1


@pytest.mark.parametrize("max_words", [1, 7, 1 << 20])
def test_shards_of_the_key_space_say_what_one_cascade_says(spark, max_words):
    keys = [*(f"h{i % 300}" for i in range(900)), *["hot"] * 500, None, ""]
    rows = spark.createDataFrame([(i, k, 1) for i, k in enumerate(keys)], "page_id long, host string, salt int")
    listed = rows.where("page_id % 300 < 40").select("host")
    members = {r.host for r in listed.collect()} - {None}
    got = U.mark_members(rows, "host", rows.select("host"), listed, "listed", max_words)
    assert got.columns == [*rows.columns, "listed"]
    assert sorted(got.collect()) == [(i, k, 1, k in members) for i, k in enumerate(keys)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Join", "Exchange", "Python", "Arrow"))


def test_shards_without_keys_or_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "page_id long, host string")
    for some, want in ((rows, [(1, True), (2, False)]), (rows.where("false"), [])):
        got = U.mark_members(some, "host", rows.select("host"), rows.select("host"), "m", max_words=1)
        assert sorted(tuple(r) for r in got.select("page_id", "m").collect()) == want


def test_the_words_of_a_cascade_are_foreseen(spark):
    for n_in, n_out in ((400, 4000), (3000, 1000), (1000, 1300)):
        keys = spark.range(n_in + n_out).select(F.concat(F.lit("k"), "id").alias("k"))
        cascade = U.build_cascade(keys, keys.limit(n_in))
        used = sum(level.n_words for level in cascade.levels)
        assert used <= 1.2 * U.cascade_words(n_in, n_out) + len(cascade.levels)


def test_no_join_and_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.com/") for i in range(20)], "page_id long, url string")
    listed = pages.where("page_id < 5").select(U.host_and_path(F.col("url"))[0].alias("h"))
    plan = U.judge_urls(pages, URL_RULES, listed)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Join", "Exchange", "Python", "Arrow"))
