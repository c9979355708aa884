"""SimHash near-duplicates: fingerprints linked at a few differing bits, found by pigeonring filtering.

A fingerprint has a bit set if it is set in over half of the XXH64 hashes of the word shingles. Two
fingerprints link at ``max_bits`` differing bits or fewer.

Pigeonring: cut the 64 bits into a ring of ``segments``. If two fingerprints differ in at most t bits,
some segment starts a chain in which, for every length l, the first l segments differ in at most
l * t / segments bits in total. The first ``chain`` lengths make the join key: every fingerprint is
filed under its chain bits from each start and looks up those bits with every difference that the
budgets allow (17 per start for 3 bits, 4 segments and chains of 2). What meets there is checked for
the remaining lengths, and only then for the full distance. A pair counts at its first viable start,
so that it appears once.

Equal fingerprints are folded to one row before anything is joined; a group of copies of any size
costs one row. Components come from alternating star contractions over the links, each round stored in
the shared folder. Documents take their component over their fingerprint in a join that splits hot keys.

Defined results: null and wordless texts have fingerprint zero and link like any other; a text with
fewer words than a shingle is one shingle; a null id takes part, but a component is named by its smallest
non-null id (null if it has none); repeated rows get the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runout.llm.common import BROADCAST_ROWS, arrow_schema, lookup, ship, slices, stored

SEED = 42
#: (segments, chain, distinct fingerprints up to which the key is selective enough): the key has
#: 64 * chain / segments bits, of which random meetings stay below the number of fingerprints.
RINGS = ((4, 2, 1 << 27), (8, 5, 1 << 62))
#: A node with more than this part of the edges is a hub, and the keys that a hub is spread over.
HUB_SHARE, HUB_SALTS = 1000, 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8) * 256


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of one text as an unsigned integer."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        octets = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8) + _PLACES
        total += (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row of ``docs``; fp holds the 64 bits as a signed long."""
    ship(docs.sparkSession)
    df = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    ddl = f"`{id_col}` {df.schema[0].dataType.simpleString()}, fp long"
    schema = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(schema[0].type), pa.array(prints.view(np.int64))], schema=schema
            )

    return df.mapInArrow(run, ddl)


def chain_masks(segments: int, chain: int, max_bits: int) -> list[int]:
    """Every difference that the budgets allow in the first ``chain`` segments from a start."""
    width = 64 // segments
    masks = []
    for n in range(chain * max_bits // segments + 1):
        for bits in combinations(range(chain * width), n):
            if all(
                sum(b < length * width for b in bits) <= length * max_bits // segments
                for length in range(1, chain + 1)
            ):
                masks.append(sum(1 << b for b in bits))
    return masks


def _rotated(fp: Column, start: int, width: int) -> Column:
    """The ring read from segment ``start`` on, lowest bits first."""
    n = start * width
    return fp if n == 0 else F.shiftrightunsigned(fp, n).bitwiseOR(F.shiftleft(fp, 64 - n))


def _viable(diff: Column, start: int, segments: int, max_bits: int) -> Column:
    """The chain condition for every length from one start."""
    width = 64 // segments
    ring = _rotated(diff, start, width)
    checks = [
        F.bit_count(ring.bitwiseAND(F.lit((1 << length * width) - 1))) <= length * max_bits // segments
        for length in range(1, segments)
    ]
    return _all(checks)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def links(prints: DataFrame, max_bits: int = 3, segments: int = 4, chain: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct long column ``fp`` at ``max_bits`` differing bits or fewer."""
    width = 64 // segments
    key_mask = F.lit((1 << chain * width) - 1)
    starts = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("start"), _rotated(F.col("fp"), i, width).bitwiseAND(key_mask).alias("key"))
                for i in range(segments)
            )
        )
    )
    filed = prints.select("fp", starts.alias("s")).select("fp", "s.start", "s.key")
    masks = F.array(*(F.lit(m).cast("long") for m in chain_masks(segments, chain, max_bits)))
    asked = filed.select(
        F.col("fp").alias("a"), "start", F.col("key"), F.explode(masks).alias("mask")
    ).select("a", "start", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    filed = filed.select(F.col("fp").alias("b"), "start", "key")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(
        *(F.when(_viable(diff, i, segments, max_bits), F.lit(i)) for i in range(segments)), F.lit(-1)
    )
    pairs = asked.hint("merge").join(filed, ["start", "key"]).where(
        (F.col("a") < F.col("b")) & (F.col("start") == first) & (F.bit_count(diff) <= max_bits)
    )
    return pairs.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Large-star and small-star contractions in turn until nothing changes. Every round is stored, so
    plans stay short and a lost executor costs one round.
    """
    now, state = stored(edges.select("a", "b")), None
    n = now.count()
    while True:
        now = stored(_star(_star(now, n, large=True), n, large=False))
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == state:
            break
        n, state = row[0], tuple(row)
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _star(edges: DataFrame, n_edges: int, large: bool) -> DataFrame:
    """One contraction. Edges are (a, b) with a < b; so are those returned, each once.

    Large star: every node links its larger neighbours to the smallest of itself and its neighbours.
    Small star: every node links itself and its smaller neighbours to the smallest of these.
    """
    if large:
        near = edges.unionAll(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    else:
        near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if large:
        least = least.withColumn("m", F.least("m", "u"))
        out = _with_least(near.where("v > u"), least, n_edges)
    else:
        out = _with_least(near, least, n_edges)
        out = out.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def _with_least(near: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """Every neighbour v of a node u with the node's m, as (m, v).

    A node that holds more than the ``HUB_SHARE``-th part of the edges is a hub, so there are no more than twice
    ``HUB_SHARE`` hubs: they are broadcast, and each one's neighbours are spread over ``HUB_SALTS`` keys.
    """
    many = n_edges / HUB_SHARE
    hubs = least.where(F.col("n") > many).select(F.col("u").alias("hub"))
    spread = F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS))).cast("int")
    near = near.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left").withColumn("salt", spread).drop("hub")
    every = F.when(F.col("n") > many, F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = least.select("u", "m", F.explode(every).alias("salt"))
    return near.join(salted, ["u", "salt"]).select(F.col("m").alias("a"), F.col("v").alias("b"))


def fingerprint_groups(prints: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """(fp, root, component_id) for fingerprints of several rows or with a link; other rows stand alone.

    ``root`` names the component by fingerprint, ``component_id`` by its smallest id.
    """
    folded = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    distinct = folded.count()
    segments, chain = next((s, c) for s, c, most in RINGS if distinct <= most)
    if max_bits >= segments:
        raise ValueError("more bits than segments leave no exact segment to file by")
    roots = stored(components(stored(links(folded.select("fp"), max_bits, segments, chain))))
    linked = folded.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "fp"))
    linked = stored(linked.select("fp", "root", "least"))
    named = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    return stored(lookup(linked, named, "root", ["fp"]).select("fp", "root", "component_id"))


def near_duplicates(
    docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) per row of ``docs``."""
    prints = stored(fingerprints(docs, words, id_col, text_col))
    found = lookup(prints, fingerprint_groups(prints, id_col, max_bits), "fp", [id_col])
    return found.select(
        id_col,
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("root").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs``, all columns, per component: the one with the smallest ``doc_id``.

    The ids that go are joined away, by broadcast if they are few. Ids that several rows carry, null
    included, are told apart by their text: of a component that such an id names, one row stays.
    """
    prints = stored(fingerprints(docs, words))
    groups = fingerprint_groups(prints, "doc_id", max_bits)
    shared = stored(prints.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    judged = lookup(prints, groups, "fp", ["doc_id"]).where("root IS NOT NULL")
    gone = stored(judged.where("NOT doc_id <=> component_id").select("doc_id").distinct())
    if shared.isEmpty():
        few = gone.count() <= 5 * BROADCAST_ROWS
        return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    return _drop_with_shared_ids(docs, groups, gone, shared, words)


def _drop_with_shared_ids(
    docs: DataFrame, groups: DataFrame, gone: DataFrame, shared: DataFrame, words: int
) -> DataFrame:
    """The general case: rows whose id is shared get their fingerprint beside their columns."""
    ship(docs.sparkSession)
    known = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
    single = docs.alias("d").join(shared.alias("x"), known, "left_anti")
    single = single.join(gone, "doc_id", "left_anti")
    several = docs.alias("d").join(shared.alias("x"), known, "left_semi")
    columns = docs.columns
    inner = [f"__c{i}" for i in range(len(columns))]
    place = columns.index("text")
    ddl = several.toDF(*inner).schema.add("__fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, inner[place]):
            prints = np.array([fingerprint(t, words) for t in batch.column(place).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prints.view(np.int64))], names=[*inner, "__fp"]
            )

    marked = several.toDF(*inner).mapInArrow(run, ddl).withColumnRenamed("__fp", "fp")
    doc_id = F.col(inner[columns.index("doc_id")])
    found = lookup(marked, groups, "fp", inner[:1])
    alone = found.where("root IS NULL")
    named = found.where(F.col("root").isNotNull() & doc_id.eqNullSafe(F.col("component_id")))
    kept = alone.unionByName(named.dropDuplicates(["root"])).select(*inner).toDF(*columns)
    return single.unionByName(kept)
