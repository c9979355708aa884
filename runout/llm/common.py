"""Helpers shared by the text operators: shared scratch tables, package shipping, batches, look-ups."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from runout.sources.sinks import scratch_folder

#: Rows of fixed-width columns up to which a measured table is broadcast (16 to 32 bytes a row).
BROADCAST_ROWS = 200_000
#: Characters that a Python worker holds at once, whatever the size of the Arrow batch.
BATCH_CHARS = 2_000_000
#: Rows and bytes that Spark hands to a Python worker at once.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 2_500,
    "spark.sql.execution.arrow.maxBytesPerBatch": 16 * 1024 * 1024,
}


def file_folder(spark: SparkSession) -> str:
    """A new scratch folder as a URI, for tasks that write and read files of their own format there."""
    folder = scratch_folder(spark)
    if "://" in folder or folder.startswith("file:"):
        return folder
    # a bare path belongs to Spark's default file system: ask a file in it for its whole name
    spark.range(1).write.parquet(f"{folder}/probe")
    (probe,) = spark.read.parquet(f"{folder}/probe").inputFiles()[:1]
    return probe[: probe.index(folder) + len(folder)]


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: a lost executor then costs no upstream work."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_shipped: set[str] = set()
_UNITS = {"": 1, "b": 1} | {u: 1024**i for i, c in enumerate("kmgtp", 1) for u in (c, f"{c}b")}


def bytes_of(size: str) -> int:
    """A number of bytes as Spark writes it: ``64m``, ``16777216b``, ``1g`` or a plain number."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) * _UNITS[unit]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and bound their Arrow batches.

    A batch is held by the executor and by its worker at once, so the session's bounds are lowered where
    they are larger. Spark reads them when a plan runs, which may be long after it is composed: they stay
    lowered for the session's later queries, whose results they cannot change.
    """
    for setting, most in ARROW_BATCH.items():
        if not 0 < bytes_of(spark.conf.get(setting)) <= most:
            spark.conf.set(setting, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="runout-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "runout_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def slices(
    batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_CHARS
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of the column ``text``, or one long text."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        start = size = 0
        for i, n in enumerate(pc.binary_length(column).to_pylist()):
            size += n or 0
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema that Spark expects for a DDL string."""
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def crc_of(doc_id: Column) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows of one part of the ids by crc32; rows without an id are in it as well."""
    return F.coalesce(crc_of(doc_id) % parts == part, F.lit(True))


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Left join a stored table with one row per key; a key may hold a third of ``rows``.

    The table is counted first. Up to ``BROADCAST_ROWS`` it is broadcast. Beyond that both sides are
    shuffled by the key and one of 32 salts, taken from the ``spread`` columns of ``rows``, so that a
    hot key is split even before AQE splits it further.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    salts = 32
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    return rows.withColumn("__salt", salt).join(salted, [key, "__salt"], "left").drop("__salt")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_chars: int | None = None
) -> DataFrame:
    """(text, label) of at most ``per_class`` labelled ids per class: those whose id hashes lowest.

    The ids are bounded, hence broadcast to their documents; should ids repeat in ``docs``, the rows whose
    id and text hash lowest are kept, twice as many as there are ids. Texts of more than ``most_chars``
    characters are left out where they are read.
    """
    rows = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    lot = F.xxhash64("doc_id", F.lit(label))
    ids = rows.where("label = 0").orderBy(lot).limit(per_class)
    ids = ids.unionAll(rows.where("label = 1").orderBy(lot).limit(per_class))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    if most_chars is not None:
        found = found.where(F.length("text") <= most_chars)
    return found.orderBy(lot, F.xxhash64("text"), "label").limit(4 * per_class).select("text", "label")


def class_counts(labels: DataFrame, label: str, learn: Column) -> tuple[int, int]:
    """Rows labelled 0 and 1 that may be learned from."""
    rows = labels.where(learn & F.col("doc_id").isNotNull())
    return tuple(rows.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first())
