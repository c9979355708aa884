r"""Repair of the structure of conversations: the cheapest edits after which roles follow the grammar.

The role initials of a repaired conversation match ``(s?(ua)+)?``. Edits are Keep (0), Rerole to user or
assistant (2), Delete (3, required for blank and repeated rows) and Insert of an empty turn of user or
assistant (2); a truncated row that is not deleted costs 1 more. Of all cheapest ways the one whose audit, the
initials of its edits in order, comes first in ASCII order is taken.

Rows and states of the grammar span a graph: a node is a place between rows and a state, an arc an edit. The
cost of every node to the end follows from the last row backwards. Arcs that lie on a cheapest way are kept;
those of one node have different letters, since a state has one next role, so every node has a single least
arc. Its letter is the node's rank by audits of length 1 and its head the node's pointer. By doubling, the
rank by audits of length 2^(k+1) is that of the pair of ranks by 2^k, of the node and of the node its pointer
names, and the pointer is that pointer's pointer. When no pointer moves any more the ranks order all nodes by
whole audits; the way itself is unrolled from the doubled pointers, 2^k letters after 2^k letters.

Rows are dealt in sections, ranges of (conv_id, turn, role, text digest), so that one conversation may hold
any share of them: a section is a bounded number of rows without their texts. For conversations that lie in
several sections, at most one less than there are sections, the costs through each piece (4 x 4 numbers) and
then the state in which each piece is left are passed on between pieces; all else is done within sections.
The texts are shuffled once, to meet the edits of their rows, and only one text is held at a time.

Defined results: a null role or text is one space; rows are ordered by turn (nulls first), role and SHA-256 of
the text, and copies follow each other; a role that is empty or begins with another letter than s, u or a
cannot be kept; rows without conv_id are one conversation; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runout.llm.common import arrow_schema, crc_of, lookup, ship, stored

#: Rows of a section, about; a section has no texts.
SECTION_ROWS = 100_000
#: Rows of short pieces that are resolved together, and rows of a piece that is resolved alone.
CHUNK_ROWS, ALONE_ROWS = 10_000, 64
#: Rows handed on at once.
OUT_ROWS = 2_500
BLANKS = " \t\n\x0b\x0c\r"
INSERTED = {"u": "user", "a": "assistant"}

RECAST, DELETED, PUT = 2, 3, 2
EMPTY, S, U, A = range(4)
FAR = 1 << 50
#: The state after the next role that a state permits beside system, and that role's letter.
NEXT = np.array([U, U, A, U])
NEXT_ROLE = "uuau"
#: State by initial (other, s, u, a) and state; -1 where the grammar has none.
STEP = np.array([[-1] * 4, [S, -1, -1, -1], [U, U, -1, U], [-1, -1, A, -1]])
#: Costs at the end of a conversation: an empty one and one that ends with an assistant are done.
FINAL = (0, 4, 2, 0)
MUST_GO, CUT = 4, 8

Piece = tuple[int, object]  # section and conv_id
Around = tuple[tuple[int, ...], int, bool]  # costs at its end, state at its start, whether the conversation ends


def _edges(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row and state: costs of keeping and of another role, and the state after keeping."""
    must, cut = (kinds & MUST_GO)[:, None] > 0, ((kinds & CUT) > 0).astype(np.int64)[:, None]
    after = STEP[kinds & 3]
    return np.where(must | (after < 0), FAR, cut), np.where(must, FAR, cut + RECAST) + np.zeros((1, 4), int), after


def costs(kinds: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs from every place and state to the end of its piece, whose costs ``ends`` gives.

    A piece of n rows has n + 1 places; pieces lie one after the other.
    """
    keep, recast, after = _edges(kinds)
    place_end, row_end = np.cumsum(lengths + 1) - 1, np.cumsum(lengths)
    cost = np.empty((len(kinds) + len(lengths), 4), np.int64)
    cost[place_end] = ends
    order = np.argsort(-lengths, kind="stable")
    place_end, row_end, falling = place_end[order], row_end[order], -lengths[order]
    for step in range(1, int(lengths.max(initial=0)) + 1):
        m = np.searchsorted(falling, -step, side="right")
        place, row = place_end[:m] - step, row_end[:m] - step
        then = cost[place + 1]
        kept = keep[row] + np.take_along_axis(then, np.maximum(after[row], 0), axis=1)
        x = np.minimum(np.minimum(then + DELETED, kept), recast[row] + then[:, NEXT])
        u, a = np.minimum(x[:, U], x[:, A] + PUT), np.minimum(x[:, A], x[:, U] + PUT)
        cost[place] = np.stack([np.minimum(x[:, EMPTY], u + PUT), np.minimum(x[:, S], u + PUT), u, a], axis=1)
    return np.minimum(cost, FAR)


def least_arcs(
    kinds: np.ndarray, lengths: np.ndarray, cost: np.ndarray, final: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Letter (0 end, then D, I, K, R) and head of every node's least arc among those on a cheapest way."""
    keep, recast, after = _edges(kinds)
    places = np.arange(len(cost))
    ends = np.cumsum(lengths + 1) - 1
    inner = np.ones(len(cost), bool)
    inner[ends] = False
    may_insert = inner.copy()
    may_insert[ends] = final
    letter = np.zeros(cost.shape, np.int64)
    head = places[:, None] * 4 + np.arange(4)
    here, then, later = cost[inner], cost[places[inner] + 1], (places[inner, None] + 1) * 4

    def choose(on: np.ndarray, fits: np.ndarray, name: int, to: np.ndarray) -> None:
        letter[on] = np.where(fits, name, letter[on])
        head[on] = np.where(fits, to, head[on])

    # from the last letter to the first, so that the first one stays
    choose(inner, here == recast + then[:, NEXT], 4, later + NEXT)
    states = np.maximum(after, 0)
    choose(inner, here == keep + np.take_along_axis(then, states, axis=1), 3, later + states)
    put = cost[may_insert] == cost[may_insert][:, NEXT] + PUT
    choose(may_insert, put, 2, places[may_insert, None] * 4 + NEXT)
    choose(inner, here == then + DELETED, 1, later + np.arange(4))
    return letter.ravel(), head.ravel()


def doubled(letter: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all nodes by their whole audits, and the pointers over 1, 2, 4, ... letters."""
    rank, pointers = np.unique(letter, return_inverse=True)[1], [head]
    while (letter[pointers[-1]] > 0).any():
        pointer = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        pointers.append(pointer[pointer])
    return rank, pointers


def unroll(start: np.ndarray, pointers: list[np.ndarray]) -> np.ndarray:
    """Nodes on the least way from every start, padded with ends."""
    way = start[:, None]
    for pointer in pointers:
        way = np.concatenate([way, pointer[way]], axis=1)
    return way


def resolve(
    kinds: np.ndarray, lengths: np.ndarray, ends: np.ndarray, states: np.ndarray, final: np.ndarray
) -> list[tuple[str, str]]:
    """Per row: letters of its edits, inserts around it included, and of the roles they give (k: the row's own)."""
    letter, head = least_arcs(kinds, lengths, costs(kinds, lengths, ends), final)
    _, pointers = doubled(letter, head)
    first = np.cumsum(lengths + 1) - lengths - 1
    way = unroll(first * 4 + states, pointers)
    piece, _ = np.nonzero(letter[way])
    nodes = way[letter[way] > 0]
    row_of = np.minimum(nodes // 4 - piece, np.cumsum(lengths)[piece] - 1)
    out = [("", "") for _ in range(len(kinds))]
    for r, name, state in zip(row_of.tolist(), letter[nodes].tolist(), (nodes % 4).tolist(), strict=True):
        edits, roles = out[r]
        out[r] = (edits + ".DIKR"[name], roles + (NEXT_ROLE[state] if name in (2, 4) else ".-.k"[name]))
    return out


def exits(kinds: np.ndarray, ends: np.ndarray, final: bool) -> list[int]:
    """For each state at the start of one piece, the state in which the least way leaves it."""
    lengths = np.array([len(kinds)])
    letter, head = least_arcs(kinds, lengths, costs(kinds, lengths, ends[None]), np.array([final]))
    _, pointers = doubled(letter, head)
    return (unroll(np.arange(4), pointers)[:, -1] % 4).tolist()


def described(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the text), text, blank and cut (the last character ends no sentence)."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        "text",
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )


SORTED = ("conv_id", "turn", "role", "digest")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of ``described`` without texts, with section and place, stored in the order of places."""
    thin = rows.select(*SORTED, "blank", "cut")
    parts = int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, math.ceil(thin.count() / SECTION_ROWS))
    # copies of one row differ in nothing; the lot lets a range end among them
    dealt = thin.withColumn("lot", F.monotonically_increasing_id()).repartitionByRange(parts, *SORTED, "lot")
    dealt = dealt.sortWithinPartitions(*SORTED).drop("lot")
    return stored(dealt.withColumns({"section": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))


def with_faults(rows: DataFrame) -> DataFrame:
    """Numbered rows with their first fault and the kind that the graph is made of."""
    identity = F.struct("conv_id", "role", "digest")
    rows = rows.withColumn("key", F.unhex(F.sha2(F.to_json(identity), 256)))
    again = rows.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("times"))
    found = lookup(rows, stored(again.where("times > 1").select("key", "first")), "key", ["place"])
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("place") > F.col("first"), "duplicate")
        .when(F.col("cut"), "truncated")
    )
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when(F.col("role") == "", 0).otherwise(initial)
    kind = initial + F.when(F.col("fault") == "truncated", CUT).when(F.col("fault").isNotNull(), MUST_GO).otherwise(0)
    return found.withColumn("fault", fault).select(*SORTED, "section", "place", "fault", kind.alias("kind"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Piece, np.ndarray, pa.Table]]:
    """Runs of rows of one section and conversation, from batches in the order of places."""
    held: list[pa.RecordBatch] = []
    at: Piece | None = None
    for batch in batches:
        start = 0
        names = list(zip(batch.column("section").to_pylist(), batch.column("conv_id").to_pylist(), strict=True))
        for i, name in enumerate(names):
            if name != at:
                if held or i > start:
                    table = pa.Table.from_batches([*held, batch.slice(start, i - start)])
                    yield at, table.column("kind").to_numpy().astype(np.int64), table
                held, start, at = [], i, name
        held.append(batch.slice(start))
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        yield at, table.column("kind").to_numpy().astype(np.int64), table


def _in_sections(rows: DataFrame) -> DataFrame:
    return rows.repartition("section").sortWithinPartitions("place")


def passed_on(rows: DataFrame) -> dict[Piece, Around]:
    """For the pieces of conversations that lie in several sections: what holds at their ends and starts."""
    edges = rows.groupBy("section").agg(
        F.min_by("conv_id", "place").alias("first"), F.max_by("conv_id", "place").alias("last")
    )
    edges = edges.orderBy("section").collect()
    split = {a.last for a, b in zip(edges, edges[1:], strict=False) if a.last == b.first}
    if not split:
        return {}
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = spark.createDataFrame([(c,) for c in split], f"split_id {kind}")
    rows = rows.join(F.broadcast(names), F.col("conv_id").eqNullSafe(F.col("split_id")), "left_semi")
    rows = stored(rows.select("conv_id", "section", "place", "kind"))
    ddl = f"conv_id {kind}, section int, found array<long>"
    schema = arrow_schema(spark, ddl)

    def each(of_piece):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (section, conv_id), kinds, _ in _pieces(batches):
                row = {"conv_id": conv_id, "section": section, "found": of_piece((section, conv_id), kinds)}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        by_conv = defaultdict(list)
        for r in sorted(_in_sections(rows).mapInArrow(run, ddl).collect(), key=lambda r: r.section):
            by_conv[r.conv_id].append((r.section, r.found))
        return by_conv

    def through(_: Piece, kinds: np.ndarray) -> list[int]:
        single = np.where(np.eye(4, dtype=bool), 0, FAR)
        return np.stack([costs(kinds, np.array([len(kinds)]), end[None])[0] for end in single], axis=1).ravel().tolist()

    at_end: dict[Piece, tuple[int, ...]] = {}
    last: dict[object, int] = {}
    for conv_id, found in each(through).items():
        cost, last[conv_id] = np.array(FINAL), found[-1][0]
        for section, matrix in reversed(found):
            at_end[section, conv_id] = tuple(cost.tolist())
            cost = (np.array(matrix).reshape(4, 4) + cost).min(axis=1)

    def left(piece: Piece, kinds: np.ndarray) -> list[int]:
        return exits(kinds, np.array(at_end[piece]), last[piece[1]] == piece[0])

    around: dict[Piece, Around] = {}
    for conv_id, found in each(left).items():
        state = EMPTY
        for section, leaves in found:
            around[section, conv_id] = (at_end[section, conv_id], state, section == last[conv_id])
            state = leaves[state]
    return around


def edits(rows: DataFrame, around: Mapping[Piece, Around]) -> DataFrame:
    """Rows of ``with_faults`` with the letters of their edits and of the roles these give."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(*SORTED, "section", "place", "fault", "kind")
    shared = spark.sparkContext.broadcast(dict(around))
    kinds_of = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = [*SORTED, "place", "fault"]
    ddl = ", ".join(f"{n} {kinds_of[n]}" for n in kept) + ", edits string, roles string"
    schema = arrow_schema(spark, ddl)
    whole: Around = (FINAL, EMPTY, True)

    def solved(pieces: list[tuple[Piece, np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        known = [shared.value.get(p, whole) for p, *_ in pieces]
        found = resolve(
            np.concatenate([k for _, k, _ in pieces]),
            np.array([len(k) for _, k, _ in pieces]),
            np.array([k[0] for k in known]),
            np.array([k[1] for k in known]),
            np.array([k[2] for k in known]),
        )
        table = pa.concat_tables([t for *_, t in pieces]).select(kept)
        table = table.append_column("edits", pa.array([e for e, _ in found], pa.string()))
        table = table.append_column("roles", pa.array([r for _, r in found], pa.string()))
        yield from table.cast(schema).combine_chunks().to_batches(max_chunksize=OUT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Piece, np.ndarray, pa.Table]] = []
        n = 0
        for piece in _pieces(batches):
            if len(piece[1]) > ALONE_ROWS:
                yield from solved([piece])
                continue
            held.append(piece)
            n += len(piece[1])
            if n >= CHUNK_ROWS:
                yield from solved(held)
                held, n = [], 0
        if held:
            yield from solved(held)

    return _in_sections(rows).mapInArrow(run, ddl)


def repair(rows: DataFrame) -> DataFrame:
    """Every edit of every conversation, the rows of one conversation in order in one partition.

    conv_id, step, edit (K, R, D or I), turn and old_role and fault (of the row, null for inserts), role and text
    (of the repaired turn, null for deleted rows). The repaired conversation is the rows with a role.
    """
    spark = rows.sparkSession
    ship(spark)
    texts = described(rows)
    marked = stored(with_faults(numbered(texts)))
    found = edits(marked, passed_on(marked))
    texts = texts.select(*SORTED, "text")
    both = texts.unionByName(found, allowMissingColumns=True)
    # the text of a row comes before its edits, and once for all of its copies is enough
    both = both.repartition("conv_id").sortWithinPartitions(*SORTED, F.asc_nulls_first("place"))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    ddl = (
        f"conv_id {kinds['conv_id']}, step long, edit string, turn {kinds['turn']}, old_role string, fault string,"
        " role string, text string"
    )
    schema = arrow_schema(spark, ddl)
    names = ["conv_id", "turn", "role", "text", "place", "fault", "edits", "roles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, at, step = "", object(), 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, turn, role, said, place, fault, letters, given in zip(
                *(batch.column(n).to_pylist() for n in names), strict=True
            ):
                if conv_id != at:
                    at, step = conv_id, 0
                if place is None:
                    text = said
                    continue
                for edit, to in zip(letters, given, strict=True):
                    new = None if edit == "D" else role if edit == "K" else INSERTED[to]
                    if edit == "I":
                        out.append((conv_id, step, edit, None, None, None, new, ""))
                    else:
                        out.append((conv_id, step, edit, turn, role, fault, new, None if new is None else text))
                    step += 1
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return both.select(*names).mapInArrow(run, ddl)


class _Summary:
    """What one conversation's edits say, edit by edit."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.first = self.last = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.audit = bytearray()
        self.said = hashlib.sha256()
        self.any = False

    def add(self, edit: str, turn: int | None, old: str | None, fault: str | None, role: str | None, text: str) -> None:
        self.audit += edit.encode()
        self.cost += {"K": 0, "R": RECAST, "D": DELETED, "I": PUT}[edit] + (fault == "truncated" and edit != "D")
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            if self.before is not None:
                self.illegal += self.before[:1] + old[:1] not in ("su", "ua", "au")
            self.before = old
        if role is not None:
            self.said.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        numbers = (gaps, *self.faults.values(), self.illegal, self.cost)
        return self.conv_id, *numbers, self.audit.decode(), self.said.hexdigest()


def summarise(repaired: DataFrame) -> DataFrame:
    """Per conversation of the rows of ``repair``, in their order: counts, cost, audit, digest of what remains."""
    spark = repaired.sparkSession
    ship(spark)
    kind = repaired.schema["conv_id"].dataType.simpleString()
    ddl = (
        f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
        " audit string, repaired_sha256 string"
    )
    schema = arrow_schema(spark, ddl)
    names = ["edit", "turn", "old_role", "fault", "role", "text"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Summary | None = None
        done: list[tuple] = []
        for batch in batches:
            steps = zip(*(batch.column(n).to_pylist() for n in ("conv_id", "step", *names)), strict=True)
            for conv_id, step, *edit in steps:
                if step == 0:
                    if now:
                        done.append(now.row())
                    now = _Summary(conv_id)
                now.add(*edit)
            if len(done) >= OUT_ROWS:
                yield packed(done)
                done = []
        if now:
            yield packed([*done, now.row()])

    return repaired.mapInArrow(run, ddl)


def audit(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``summarise`` of the repaired rows for every conv_id of ``conversations``, also those without rows."""
    found = summarise(repair(rows))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]),
    )


def plant_faults(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32(conv_id:turn) % 20: dropped, emptied, cut, repeated, given to the user."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("lot", crc_of(name) % 20).where("lot != 0")
    text: Column = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
