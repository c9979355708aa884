"""Extract files: find the latest of each table and read them as text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runout.sources.schemas import EXTRACTS
from runout.sources.sinks import Tables

# <anything>/<TABLE>.csv or <TABLE>_<stamp>.csv, either one file or a folder of part files: the table is
# what stands before the first underscore
EXTRACT_PATH = r"^(.*?/([^/_]*)(?:_([^/]*))?\.csv)(?:/.*)?$"


def extract_latest(spark: SparkSession, root: str) -> DataFrame:
    """The extract to load per table: ``(table_name, stamp, path)``; the stamp may be empty.

    Searches ``root`` recursively. With several extracts of a table the one with the lexicographically
    last path counts. The listing reads no file contents. Files whose name begins with an underscore
    or a dot are hidden, as everywhere in Spark; every other ``.csv`` is listed.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select("path")
    )
    return (
        files.select(
            F.regexp_extract("path", EXTRACT_PATH, 2).alias("table_name"),
            F.regexp_extract("path", EXTRACT_PATH, 3).alias("stamp"),
            F.regexp_extract("path", EXTRACT_PATH, 1).alias("path"),
        )
        .groupBy("table_name")
        .agg(F.max_by("stamp", "path").alias("stamp"), F.max("path").alias("path"))
    )


def bronze_read(
    spark: SparkSession,
    table: str,
    path: str,
    na_values: Iterable[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """One extract with every column as text, in the declared columns.

    Columns are taken by header name, in any case and order; a declared column the file lacks is
    NULL, an undeclared one is an error. Empty fields are NULL, quoted or not, and so are those
    that equal one of ``na_values``. ``multi_line`` allows line breaks inside quoted fields, at the
    price of files that cannot be split.

    Nothing is dropped or moved in silence: part files must all have the header of the first, and a
    row with more or fewer fields than the header, as half a row is after a line break, is an error.
    """
    declared = EXTRACTS[table].fieldNames()

    def reader():
        options = {"header": True, "escape": '"', "multiLine": multi_line}
        return spark.read.options(**options)

    header = reader().csv(path).columns
    names = [c.lower() for c in header]
    unknown = sorted(set(names) - set(declared))
    if unknown:
        raise ValueError(f"{table}: columns not in the declared schema: {unknown}")
    missing = ["", *na_values]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = (
        reader()
        .options(mode="FAILFAST", enforceSchema=False, columnPruning=False)
        .schema(schema)
        .csv(path)
        .toDF(*names)
    )

    def cleaned(name: str):
        if name not in names:
            return F.lit(None).cast("string")
        return F.when(~F.col(name).isin(missing), F.col(name))

    return raw.select([cleaned(name).alias(name) for name in declared])


def read_extracts(
    spark: SparkSession, root: str, na_values: Iterable[str] = (), multi_line: bool = False
) -> dict[str, DataFrame]:
    """The latest extract of every table under ``root``; a file of no declared table is an error.

    Collects one path per table, at most as many as there are declared tables.
    """
    latest = {r.table_name: r.path for r in extract_latest(spark, root).collect()}
    unknown = sorted(set(latest) - set(EXTRACTS))
    if unknown:
        raise ValueError(f"extracts of undeclared tables: {unknown}")
    return {
        table: bronze_read(spark, table, path, na_values, multi_line)
        for table, path in sorted(latest.items())
    }


def load(tables: Tables, extracts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Store extracts with their declared columns; each is read once, and counted as it is written."""
    return {table: tables.write(table, df, EXTRACTS[table]) for table, df in extracts.items()}


def load_audit(tables: Tables, names: Iterable[str]) -> DataFrame:
    """Rows per loaded table and in total, as they were counted by the load; reads no rows."""
    counts = {name: tables.version(name).n_rows for name in names}
    rows = [*sorted(counts.items()), ("total", sum(counts.values()))]
    return tables.spark.createDataFrame(rows, "table_name string, n_rows long")
