"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces no longer than the largest permitted length. Pieces are dealt evenly to
groups of about ``GROUP`` and packed within them, longest first: a piece goes to the open bin with the
least space that still holds it. If there is none, a bin is opened whose size costs least per token
that can still be put into it. The permitted lengths are optimised jointly: a group is packed under every
set of opening sizes that can hold its longest piece, every bin is then downsized to the least-cost
permitted length that holds its contents, and the cheapest outcome is kept.

Only ids and lengths are shuffled, in a round-robin deal that no key can make uneven. A group's memory is
bounded by its size, and groups do not depend on each other. Rows are sorted within a group, so a task that
runs again gives the same bins.

Defined results: null and empty texts are one end token; ids that repeat, or are null, are packed once per
row; an empty table gives no bins; extra columns are not read; equal lengths are ordered by id and piece.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runout.llm.common import arrow_schema, ship, slices, stored
from runout.llm.token_blocks import ENCODE_CHARS, default_tokenizer, encoder

#: Permitted sequence lengths and what a sequence of that length costs: its tokens and a fixed overhead.
LENGTHS: Mapping[int, float] = {n: n + 32.0 for n in (512, 1024, 2048, 4096)}
#: Distinct words whose counts a worker keeps; packing comes last in the pipeline, where memory is short.
COUNTED_WORDS = 400_000
#: Pieces that are packed together.
GROUP = 20_000


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tokens) per row: ids of the whole text and one end id."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    df = docs.select(F.col(id_col).alias("doc_id"), "text")
    ddl = f"doc_id {df.schema[0].dataType.simpleString()}, tokens long"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, COUNTED_WORDS)
        for batch in slices(batches, "text", ENCODE_CHARS):
            counts = pa.array(words.count(batch.column(1)) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), counts], schema=schema)

    return df.mapInArrow(run, ddl)


def _fill(sizes: list[int], opening: list[int], costs: Mapping[int, float]) -> list[list[int]]:
    """Best fit of descending sizes: the places of the sizes in every bin, in the order they were put in."""
    bins: list[list[int]] = []
    spaces: list[int] = []  # distinct free spaces, ascending
    by_space: dict[int, list[int]] = {}
    left = sum(sizes)
    for i, size in enumerate(sizes):
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            b = by_space[space].pop()
            if not by_space[space]:
                del by_space[space], spaces[at]
            bins[b].append(i)
        else:
            space = min((c for c in opening if c >= size), key=lambda c: (costs[c] / min(c, left), c))
            b = len(bins)
            bins.append([i])
        if rest := space - size:
            if rest not in by_space:
                by_space[rest] = []
                insort(spaces, rest)
            by_space[rest].append(b)
        left -= size
    return bins


def pack(sizes: list[int], costs: Mapping[int, float] = LENGTHS) -> tuple[list[list[int]], list[int]]:
    """Bins of places in ``sizes`` (descending, none over the largest length), and each bin's length."""
    if not sizes:
        return [], []
    permitted = sorted(costs)
    best, least = ([], []), math.inf
    for n in range(1, len(permitted) + 1):
        for opening in combinations(permitted, n):
            if opening[-1] < sizes[0]:
                continue
            bins = _fill(sizes, list(opening), costs)
            contents = [sum(sizes[i] for i in b) for b in bins]
            lengths = [min((c for c in permitted if c >= x), key=lambda c: (costs[c], c)) for x in contents]
            if (total := sum(costs[c] for c in lengths)) < least:
                best, least = (bins, lengths), total
    return best


def pack_documents(lengths: DataFrame, costs: Mapping[int, float] = LENGTHS, group: int = GROUP) -> DataFrame:
    """Where each piece of (doc_id, tokens) rows lies.

    Per piece: doc_id, first_token (of the piece in its document), n_tokens, bin, capacity (the bin's
    length) and position (of the piece in the bin). ``bin`` is unique over all groups.
    """
    spark = lengths.sparkSession
    ship(spark)
    lengths = stored(lengths.select("doc_id", "tokens").where("tokens > 0"))
    most = max(costs)
    pieces = lengths.select(
        "doc_id",
        "tokens",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / most))).alias("piece"),
    ).select(
        "doc_id",
        (F.col("piece") * most).alias("first_token"),
        F.least(F.col("tokens") - F.col("piece") * most, F.lit(most).cast("long")).alias("n_tokens"),
    )
    n = lengths.agg(F.sum(F.ceil(F.col("tokens") / most))).first()[0] or 0
    kind = lengths.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, first_token long, n_tokens long, bin long, capacity int, position int"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("first_token", "ascending")])
        sizes = table.column("n_tokens").to_pylist()
        bins, capacities = pack(sizes, costs)
        base = TaskContext.get().partitionId() << 32
        order = np.array([i for b in bins for i in b], np.int64)
        held = np.array([len(b) for b in bins])
        size = np.array(sizes, np.int64)[order]
        of_bin = np.repeat(np.arange(len(bins)), held)
        before = np.cumsum(size) - size
        position = before - before[np.cumsum(held) - held][of_bin]
        rows = table.take(pa.array(order))
        columns = [
            *(rows.column(c).combine_chunks() for c in ("doc_id", "first_token", "n_tokens")),
            pa.array(base + of_bin),
            pa.array(np.array(capacities, np.int32)[of_bin]),
            pa.array(position.astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pieces.repartition(max(1, math.ceil(n / group))).mapInArrow(run, ddl)
