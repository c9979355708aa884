import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runout.llm import conversation_repair as R
from runout.llm.queries import QUERIES

DDL = "conv_id long, turn long, role string, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORDS.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows, most=3):
    """Every sequence of edits with up to ``most`` inserts, and the cheapest, ASCII-least one."""
    marks, best = faults(rows), [(10**9, "", [])]

    def go(i, inserts, cost, audit, roles, said):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0], (cost, audit, said))
        if inserts:
            for role in ("user", "assistant"):
                go(i, inserts - 1, cost + 2, audit + "I", roles + role[0], [*said, f"{role}:"])
        if i < len(rows):
            (_, role, text), mark = rows[i], marks[i]
            go(i + 1, inserts, cost + 3, audit + "D", roles, said)
            if mark not in ("blank", "duplicate"):
                more = cost + (mark == "truncated")
                if role:
                    go(i + 1, inserts, more, audit + "K", roles + role[0], [*said, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, inserts, more + 2, audit + "R", roles + new[0], [*said, f"{new}:{text}"])

    go(0, most, 0, "", "", [])
    return best[0]


def expected(rows, most=3):
    marks = Counter(faults(rows))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, said = brute(rows, most)
    return gaps, marks["blank"], marks["duplicate"], marks["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def ordered(rows):
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def found(df, ids=None):
    got = R.audit(df, df if ids is None else ids).collect()
    out = {r.conv_id: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def conversations(seed, n, most):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
        texts = ["a.", "b!", "cut", "  ", "", None, "c?\n", "d\x0b", "."]
        m = rng.randrange(1, most + 1)
        said = [rng.choice(texts) if rng.random() < 0.5 else f"t{t}." for t in range(m)]
        out[i] = [(rng.choice([t, t, t, None, 2]), rng.choice(roles), said[t]) for t in range(m)]
    return out


@pytest.mark.parametrize(("seed", "sections"), [(1, 4), (2, 40)])
def test_edits_are_the_cheapest_and_least(spark, seed, sections):
    made = conversations(seed, 120, 4)
    rows = [(i, *r) for i, rs in made.items() for r in rs]
    spark.conf.set("spark.sql.shuffle.partitions", sections)  # conversations end up in several sections
    try:
        got = found(spark.createDataFrame(rows, DDL).repartition(3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {i: expected(ordered(rs)) for i, rs in made.items()}
    assert got == want


def test_pieces_say_what_the_whole_says():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40, 300):
        kinds = rng.integers(0, 4, n) | rng.choice([0, 0, 0, R.MUST_GO, R.CUT], n)
        whole = R.resolve(kinds, np.array([n]), np.array([R.FINAL]), np.array([R.EMPTY]), np.array([True]))
        cuts = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
        parts = [kinds[a:b] for a, b in itertools.pairwise(cuts)]
        ends, cost = [], np.array(R.FINAL)
        for part in reversed(parts):
            ends.append(cost)
            cost = R.costs(part, np.array([len(part)]), cost[None])[0]
        state, got = R.EMPTY, []
        for part, end in zip(parts, reversed(ends), strict=True):
            last = part is parts[-1]
            got += R.resolve(part, np.array([len(part)]), end[None], np.array([state]), np.array([last]))
            state = R.exits(part, end, last)[state]
        assert "".join(e for e, _ in got) == "".join(e for e, _ in whole)
        assert "".join(r for _, r in got) == "".join(r for _, r in whole)


def test_ranks_order_the_audits_of_all_nodes():
    rng = np.random.default_rng(6)
    kinds = rng.integers(0, 4, 60) | rng.choice([0, 0, R.MUST_GO, R.CUT], 60)
    lengths = np.array([1, 9, 20, 30])
    final = np.ones(4, bool)
    cost = R.costs(kinds, lengths, np.array([R.FINAL] * 4))
    letter, head = R.least_arcs(kinds, lengths, cost, final)
    ranks, _ = R.doubled(letter, head)

    def audit(node):
        return "" if not letter[node] else " DIKR"[letter[node]] + audit(head[node])

    audits = [audit(i) for i in range(len(letter))]
    assert [ranks[i] for i in np.argsort(ranks, kind="stable")] == sorted(ranks)
    assert len(set(audits)) == ranks.max() + 1
    assert sorted(range(len(audits)), key=lambda i: (audits[i], i)) == sorted(range(len(audits)), key=lambda i: (ranks[i], i))


def test_a_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "SECTION_ROWS", 500)
    rng = random.Random(8)
    one = [(i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"t{i}.", f"cut{i}"])) for i in range(6000)]
    rows = [(1, *r) for r in one] + [(10 + i, t, "ua"[t % 2] + "x", f"{t}.") for i in range(1000) for t in range(6)]
    got = found(spark.createDataFrame(rows, DDL))
    kept = ordered(one)
    marks = faults(kept)
    kinds = np.array(["_sua".index(r[0]) | (R.MUST_GO if m == "duplicate" else R.CUT if m else 0) for (_, r, _), m in zip(kept, marks, strict=True)])
    whole = R.resolve(kinds, np.array([6000]), np.array([R.FINAL]), np.array([R.EMPTY]), np.array([True]))
    assert got[1][6] == "".join(e for e, _ in whole)
    assert got[1][5] == R.costs(kinds, np.array([6000]), np.array([R.FINAL]))[0, 0]
    assert got[1][1:4] == tuple(Counter(marks)[m] for m in ("blank", "duplicate", "truncated"))
    assert {got[10 + i][6] for i in range(1000)} == {"KKKKKK"}


def test_the_query_damages_and_repairs(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    rows = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append(r)
    want = {}
    for conv_id, rs in rows.items():
        kept = []
        for r in rs:
            lot = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
            text = "" if lot == 1 else re.sub("[.!?]", "", r.text) if lot == 2 else r.text
            kept += [(r.turn, "user" if lot == 4 else r.role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        want[conv_id] = expected(ordered(kept), 2) if kept else (0, 0, 0, 0, 0, 0, "", EMPTY)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert got == want


def test_edge_rows(spark):
    long = "wort " * 100_000
    rows = [(1, None, None, None), (1, 0, "user", long), (None, 3, "user", "a."), (None, 9, "assistant", "b."), (None, None, "assistant", "b.")]
    rows += [(2, 5, "user", "same.")] * 4 + [(3, None, "user", "x."), (3, None, "assistant", "y.")] + [(4, 0, "user", " ")]
    df = spark.createDataFrame(rows, DDL).withColumns({"place": F.lit("x"), "section": F.lit(1), "lot": F.lit(2), "digest": F.lit(None), "kind": F.lit(0), "key": F.lit(1), "first": F.lit(1)})
    by_id = {}
    for c, *r in rows:
        by_id.setdefault(c, []).append(tuple(r))
    ids = df.select("conv_id", "kind").union(spark.createDataFrame([(77, 1)], "conv_id long, kind int"))
    want = {c: expected(ordered(rs)) for c, rs in by_id.items()}
    assert found(df, ids) == {**want, 77: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert found(df.where("false")) == {} and R.repair(df.where("false")).count() == 0
    steps = [r for r in R.repair(df).collect() if r.conv_id == 2]
    said = [("K", "user", "same.", None), *[("D", None, None, "duplicate")] * 3, ("I", "assistant", "", None)]
    assert [(r.edit, r.role, r.text, r.fault) for r in sorted(steps, key=lambda r: r.step)] == said
    assert R.plant_faults(df).columns == ["conv_id", "turn", "role", "text"]
