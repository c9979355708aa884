r"""Conversations as training examples: one per assistant turn, with all turns before it as its context.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts and roles, ``<`` and ``|`` with any
number of backslashes between them get one backslash more, so that no text holds a control string and the
way back is to take one away; in roles, backslashes and line feeds are escaped before.

Every assistant turn is an example of its own: its context is everything before the turn in the
conversation's formatted text, and only the reply is trainable. Examples of one conversation are prefixes of
each other, so ``expand`` writes each turn once, with the number of the first example that holds it, its
offset and, for replies, the trainable span: example e is the rows up to and with number e.
``whole_examples`` makes the examples, each with a copy of its whole context, and ``read_back`` says what
those examples hold.

A turn is formatted where it is read; the one shuffle is by conversation, whose rows Spark sorts outside
memory, numbers with running windows and hands on in order. Examples are made and read behind that shuffle,
so the copies, which grow with the square of a conversation's turns, pass through a task and lie nowhere; a
task holds one conversation's text.

Defined results: rows are ordered by turn (nulls first), then role, then text; a null text is empty, a null
role an empty one; turns without an assistant turn after them belong to no example (their number is that of
the example that would follow); repeated rows are turns like others; rows without conv_id are one
conversation; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runout.llm.common import BATCH_CHARS, arrow_schema, ship, slices

START = "<|im_start|>"
END = "<|im_end|>\n"
TRAINED_ROLE = "assistant"
#: Conversations, or examples, that a task hands on at once.
OUT_ROWS = 2_000


def escape(text: Column) -> Column:
    r"""``<``, backslashes, ``|``: one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    backslash = F.lit("\\")
    role = F.replace(role, backslash, F.lit("\\\\"))
    return escape(F.replace(role, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(rows: DataFrame, trained: str = TRAINED_ROLE) -> DataFrame:
    """Per row: conv_id, turn, role, body, formatted, chars, and the trainable span of replies in formatted."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = rows.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        escape(text).alias("body"),
    )
    reply, head = F.col("role") == trained, F.char_length("head")
    return parts.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "body", F.lit(END)).alias("formatted"),
        (head + F.char_length("body") + len(END)).cast("long").alias("chars"),
        F.when(reply, head.cast("long")).alias("loss_from"),
        F.when(reply, (head + F.char_length("body")).cast("long")).alias("loss_to"),
    )


def expand(rows: DataFrame, trained: str = TRAINED_ROLE) -> DataFrame:
    """Per turn: conv_id, position, example, formatted, start, loss_start, loss_end (offsets in code points).

    The rows of a conversation lie in order in one partition. A row with a span is the reply of its example;
    the context of the example is the first ``start`` characters of the conversation.
    """
    turns = format_turns(rows, trained)
    ordered = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "formatted")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reply = F.col("loss_from").isNotNull()
    numbered = turns.select(
        "*",
        (F.row_number().over(ordered) - 1).cast("long").alias("position"),
        (F.sum("chars").over(so_far) - F.col("chars")).alias("start"),
        (F.count_if(reply).over(so_far) + F.when(reply, 0).otherwise(1)).alias("example"),
    )
    return numbered.select(
        "conv_id",
        "position",
        "example",
        "formatted",
        "start",
        (F.col("start") + F.col("loss_from")).alias("loss_start"),
        (F.col("start") + F.col("loss_to")).alias("loss_end"),
    )


def in_order(expanded: DataFrame) -> DataFrame:
    """Rows of ``expand`` that were stored in between, by conversation and in order again."""
    return expanded.repartition("conv_id").sortWithinPartitions("conv_id", "position")


def _examples(
    turns: Iterator[tuple[object, int, int, str, int | None, int | None]], rest: bool
) -> Iterator[tuple[object, int, str, int | None, int | None]]:
    """Examples of the turns of conversations that lie in order; refuses turns that do not."""
    text, left, follows = "", None, 0
    for conv_id, position, example, formatted, loss_start, loss_end in turns:
        if position == 0:
            if rest and left:
                yield (*left, text, None, None)
            text, follows = "", 0
        if position != follows:
            raise ValueError(f"conversation {conv_id}: turn {position} after {follows} turns")
        text += formatted
        follows += 1
        left = (conv_id, example) if loss_end is None else None
        if loss_end is not None:
            yield conv_id, example, text, loss_start, loss_end
    if rest and left:
        yield (*left, text, None, None)


def whole_examples(expanded: DataFrame, rest: bool = False) -> DataFrame:
    """Every example with a copy of its context: conv_id, example, text, loss_start, loss_end.

    Takes the rows of ``expand`` in their order and hands on a conversation's examples in order. With
    ``rest`` a conversation that does not end with a reply has one row more, without a span: all its turns.

    The output grows with the square of a conversation's turns; a task holds one conversation's text and a
    bounded number of examples.
    """
    spark = expanded.sparkSession
    ship(spark)
    kind = expanded.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, example long, text string, loss_start long, loss_end long"
    schema = arrow_schema(spark, ddl)
    names = ["conv_id", "position", "example", "formatted", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        chars = 0
        for example in _examples(_rows(batches, len(names)), rest):
            done.append(example)
            chars += len(example[2])
            if chars >= BATCH_CHARS or len(done) >= OUT_ROWS:
                yield _batch(done, schema)
                done, chars = [], 0
        if done:
            yield _batch(done, schema)

    return expanded.select(*names).mapInArrow(run, ddl)


def _rows(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def parse_turns(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role and text of the turns of a formatted text, and where the escaped text lies; refuses anything else.

    Begins with the turn at ``at``.
    """
    while at < len(text):
        head = text.find("\n", at)
        end = text.find(END, head)
        if not text.startswith(START, at) or head < 0 or end < 0:
            raise ValueError(f"no turn at character {at}")
        yield unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end]), head + 1, end
        at = end + len(END)


class _Reader:
    """Digests of one conversation, example by example.

    An example's context must begin with the whole example before it; only what follows that is parsed.
    """

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.text = ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.n_examples = self.loss_chars = 0

    def add(self, example: int, text: str, loss_start: int | None, loss_end: int | None) -> None:
        if example != self.n_examples + 1 or not text.startswith(self.text):
            raise ValueError(f"conversation {self.conv_id}: example {example} lacks turns before its reply")
        span = None
        for role, said, *span in parse_turns(text, len(self.text)):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        self.text = text
        if loss_start is not None:
            if [loss_start, loss_end] != span:
                raise ValueError(f"conversation {self.conv_id}: a span that is not a reply")
            self.n_examples += 1
            reply = unescape(text[loss_start:loss_end])
            self.loss_chars += len(reply)
            self.loss.update(reply.encode())

    def row(self) -> tuple[object, ...]:
        return (
            self.conv_id,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            len(self.text),
            self.n_examples,
        )


def read_examples(examples: DataFrame) -> DataFrame:
    """What the rows of ``whole_examples`` with the rest, in their order, say: the columns of ``read_back``."""
    spark = examples.sparkSession
    ship(spark)
    kind = examples.schema["conv_id"].dataType.simpleString()
    ddl = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long, n_examples long"
    )
    schema = arrow_schema(spark, ddl)
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        done: list[tuple] = []
        for conv_id, *example in _rows(slices(batches, "text"), len(names)):
            if example[0] == 1:
                if reader:
                    done.append(reader.row())
                reader = _Reader(conv_id)
            reader.add(*example)
            if len(done) >= OUT_ROWS:
                yield _batch(done, schema)
                done = []
        if reader:
            yield _batch([*done, reader.row()], schema)

    return examples.select(*names).mapInArrow(run, ddl)


def read_back(expanded: DataFrame) -> DataFrame:
    """Per conversation of the rows of ``expand``, in their order: what its whole examples say.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (each turn once), n_examples.
    Every example is made with its context and read; turns after the last reply are read from the rest.
    """
    return read_examples(whole_examples(expanded, rest=True))
