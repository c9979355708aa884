import random
from collections import defaultdict
from itertools import product

from runout.llm import packing as P


def cost_of(sizes, costs=P.LENGTHS):
    bins, lengths = P.pack(sizes, costs)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    for b, c in zip(bins, lengths, strict=True):
        held = sum(sizes[i] for i in b)
        assert held <= c
        assert not any(held <= other and costs[other] < costs[c] for other in costs)
    return sum(costs[c] for c in lengths)


def best_cost(sizes, costs):
    """Brute force over all assignments to as many bins as there are sizes."""
    best = float("inf")
    for places in product(range(len(sizes)), repeat=len(sizes)):
        held = defaultdict(int)
        for p, s in zip(places, sizes, strict=True):
            held[p] += s
        if max(held.values()) <= max(costs):
            best = min(best, sum(min(costs[c] for c in costs if c >= h) for h in held.values()))
    return best


def test_close_to_the_best_packing_of_few_pieces():
    rng = random.Random(2)
    costs = {4: 5.0, 8: 9.0, 16: 17.0}
    found = [(cost_of(s, costs), best_cost(s, costs)) for s in (sorted((rng.randrange(1, 17) for _ in range(6)), reverse=True) for _ in range(25))]
    assert all(got <= 1.35 * best for got, best in found)
    assert sum(got for got, _ in found) <= 1.08 * sum(best for _, best in found)


def test_several_lengths_cost_no_more_than_one():
    rng = random.Random(3)
    sizes = sorted((rng.randrange(1, 4097) for _ in range(500)), reverse=True)
    joint = cost_of(sizes)
    for opening in ([4096], [2048, 4096], [512, 1024, 2048, 4096]):
        bins = P._fill(sizes, opening, P.LENGTHS)
        held = [sum(sizes[i] for i in b) for b in bins]
        # downsized as well: only the choice of opening sizes is compared
        assert joint <= sum(min(P.LENGTHS[c] for c in P.LENGTHS if c >= x) for x in held)
    whole = sum(P.LENGTHS[4096] for _ in P._fill(sizes, [4096], P.LENGTHS))
    assert joint < whole
    assert cost_of([300]) == P.LENGTHS[512]
    assert P.pack([]) == ([], [])


def check_rows(rows, lengths):
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_bin[r.bin].append(r)
        by_doc[r.doc_id].append(r)
    for held in by_bin.values():
        held.sort(key=lambda r: r.position)
        ends = [0, *(r.position + r.n_tokens for r in held)]
        assert [r.position for r in held] == ends[:-1] and ends[-1] <= held[0].capacity
        assert len({r.capacity for r in held}) == 1
    total = defaultdict(int)
    for doc_id, n in lengths:
        total[doc_id] += n
    assert {d: sum(r.n_tokens for r in rs) for d, rs in by_doc.items()} == dict(total)


def test_documents_lie_whole_in_bins(spark):
    rng = random.Random(4)
    lengths = [(i, rng.choice([1, 3, 500, 4096, 4097, 9000, 100_000]) + rng.randrange(3)) for i in range(300)]
    lengths += [(None, 5), (None, 5), (7, 12), (7, 12)] + [(900 + i, 64) for i in range(300)]
    df = spark.createDataFrame(lengths, "doc_id long, tokens long")
    check_rows(P.pack_documents(df).collect(), lengths)
    check_rows(P.pack_documents(df, group=40).collect(), lengths)
    assert P.pack_documents(df, group=40).sort("bin", "position").collect() == P.pack_documents(df, group=40).sort("bin", "position").collect()


def test_edge_rows_and_empty_tables(spark, edge):
    counts = P.token_counts(edge)
    lengths = [(r.doc_id, r.tokens) for r in counts.collect()]
    assert len(lengths) == edge.count() and min(n for _, n in lengths) == 1
    check_rows(P.pack_documents(counts).collect(), lengths)
    assert P.pack_documents(counts.where("false")).count() == 0
