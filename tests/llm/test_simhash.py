import random
from itertools import product

import pytest
import xxhash

from runout.llm import simhash as S


def brute_fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=3):
    """rows: (id, fingerprint); the smallest id reachable per row."""
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in product(range(len(rows)), repeat=2):
        if i < j and bin(rows[i][1] ^ rows[j][1]).count("1") <= bits:
            group[root(j)] = root(i)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append(min(ids, default=None))
    return out


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def near_fingerprints(n, seed):
    """Random chains of fingerprints that differ in 0 to 5 bits, all segments alike."""
    rng = random.Random(seed)
    found = []
    while len(found) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            found.append(x)
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
    return found[:n]


@pytest.mark.parametrize(("segments", "chain"), [(4, 2), (8, 5)])
def test_links_lose_and_repeat_nothing(spark, segments, chain):
    prints = sorted({signed(x) for x in near_fingerprints(250, segments)})
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    want = [(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    assert sorted(map(tuple, S.links(df, 3, segments, chain).collect())) == want


def test_masks_keep_to_the_budgets():
    assert len(S.chain_masks(4, 2, 3)) == 17 and len(S.chain_masks(8, 5, 3)) == 25
    assert all(m < 1 << 32 and m & 0xFFFF == 0 for m in S.chain_masks(4, 2, 3))


def test_fingerprint_against_brute_force():
    for text in (None, "", "a", "A b", "one two three four FOUR", "ä ö ü " * 50, "x\x0by\x0cz w"):
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 400)]
    got = dict(map(tuple, S.components(spark.createDataFrame([*path, *star], "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 400)}}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("share", [1, 3, 50, 10**9])
def test_hubs_are_split_whatever_counts_as_one(spark, monkeypatch, share):
    monkeypatch.setattr(S, "HUB_SHARE", share)
    rng = random.Random(share)
    edges = {(0, i) for i in range(1, 200)} | {(i, 500 + i) for i in range(150, 300)}
    edges |= {tuple(sorted(rng.sample(range(1000, 1400), 2))) for _ in range(250)}
    got = dict(map(tuple, S.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()))
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert got == root


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randrange(90)) for _ in range(60)) for _ in range(25)]
    texts = [None, "", " ", "one", "ONE"]
    for t in base:
        texts += [t, t] + [t + f" more{k}" for k in range(rng.randrange(4))]
    docs = [(i * 3 % len(texts) if len(texts) % 3 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = [brute_fingerprint(t) for _, t in docs]
    want = {(i, f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, brute_components([(i, p) for (i, _), p in zip(docs, prints, strict=True)]), strict=True)}
    assert {tuple(r) for r in S.near_duplicates(df).collect()} == want
    kept = {r.doc_id for r in S.drop_near_duplicates(df).collect()}
    assert kept == {c for _, _, c in want}


def test_edge_rows(edge):
    got = S.near_duplicates(edge).collect()
    rows = edge.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = brute_components([(r.doc_id, p) for r, p in zip(rows, prints, strict=True)])
    # rows of components without an id have none; rows that stand alone have their own
    assert sorted(map(tuple, got), key=repr) == sorted(
        ((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, want, strict=True)), key=repr
    )
    assert S.near_duplicates(edge.where("false")).count() == 0


def test_one_row_of_each_group_stays_with_shared_ids(edge):
    kept = S.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    groups = {tuple(r) for r in edge.select("doc_id", "text").collect()}
    prints = {(i, t): brute_fingerprint(t) for i, t in groups}
    rows = [(i, prints[i, t]) for i, t in groups]
    components = {c for c in zip([p for _, p in rows], brute_components(rows), strict=True)}
    texts = [brute_fingerprint(r.text) for r in kept.collect()]
    # no two rows that stay are near each other, and every group keeps one
    assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(texts) for b in texts[:i])
    roots = dict(zip([p for _, p in rows], _roots([p for _, p in rows]), strict=True))
    assert sorted(roots[t] for t in texts) == sorted({roots[p] for p, _ in components})
    assert len(texts) == len({root for root in _roots([p for _, p in rows])})
    assert S.drop_near_duplicates(edge.where("false")).count() == 0


def _roots(prints):
    return brute_components([(i, p) for i, p in enumerate(prints)])


def test_hot_groups_are_one_row_and_split(spark, monkeypatch):
    """A third of all rows share a text; the join with their component is salted beyond the bound."""
    monkeypatch.setattr("runout.llm.common.BROADCAST_ROWS", 0)
    docs = [(i, "same text for all of these rows" if i % 3 else f"own text {i} with number {i * i}") for i in range(600)]
    got = S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_components([(i, S.fingerprint(t)) for i, t in docs])
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_look_ups_are_never_broadcast(spark):
    plan = S.links(spark.createDataFrame([(1,)], "fp long"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
