"""Layered tables: where a run keeps its results and reads them back."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runout.sources import files

#: Tables that are written by ranges of these columns, and sorted by them. The daily projection unfolds
#: the stored runs in their order, so it needs no shuffle of its own to be in order as well.
RANGED = {
    "int_stock_runs": ("marc_id", "day"),
    "mart_shortage_report": ("marc_id",),
    "mart_consumption": ("marc_id", "requirement_date"),
}
#: Tables that are asked for single materials, and the size of their row groups.
LOOKED_UP = {"mart_inventory_simulation", "mart_shortage_report", "mart_consumption"}
ROW_GROUP_BYTES = 16 * 1024 * 1024

LAYERS = ("bronze", "staging", "intermediate", "analytics")


def layer_of(name: str) -> str:
    """The layer a table belongs to, by its prefix; extracts are bronze."""
    prefixes = {"stg_": "staging", "int_": "intermediate", "mart_": "analytics"}
    return next((v for k, v in prefixes.items() if name.startswith(k)), "bronze")


def assert_schema(name: str, df: DataFrame, schema: T.StructType) -> None:
    """Refuse a frame whose columns or types differ from the declared ones."""
    given = [(f.name, f.dataType) for f in df.schema]
    wanted = [(f.name, f.dataType) for f in schema]
    if given != wanted:
        raise ValueError(f"{name}: schema {given} is not the declared {wanted}")


class ConcurrentWrite(RuntimeError):
    """Another writer replaced the table while this one was writing its rows."""


@dataclass(frozen=True)
class Version:
    """One committed state of a table."""

    number: int
    folder: str
    n_rows: int


class Tables:
    """Parquet tables below ``<root>/<layer>/<name>``, replaced whole by every write.

    A write puts its rows into a new folder and then adds the next entry to the table's log. An entry is
    a file that is created only if there is none of its number: it is the switch, and of two writers that
    began on the same version the second one is refused and its rows are removed. Until the entry is
    there readers see the former version, afterwards the new one, and never none. The version before the
    former is removed, so that a reader that has just begun on the former one can finish. Entries hold the
    number of rows, which is observed while they are written.

    With ``catalog`` the tables are metastore tables ``<layer>.<name>`` as well, whose location is switched.
    Staging is views only. Tables in ``RANGED`` are laid out by range, so that few row groups hold one key.
    The store must be one that does not replace a file by renaming another one to it, as HDFS is.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: bool = False):
        self.spark = spark
        self.root = root.rstrip("/")
        self.catalog = catalog
        self._catalog_lock = Lock()

    def _log(self, name: str) -> str:
        return f"{self.root}/_log/{name}"

    def versions(self, name: str) -> list[int]:
        """Numbers of the committed versions, the current one last; none if the table was never written."""
        names = files.listed(self.spark, self._log(name))
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, name: str, number: int | None = None) -> Version:
        """A committed version, the current one unless a number is given."""
        if number is None:
            numbers = self.versions(name)
            if not numbers:
                raise FileNotFoundError(f"no table {name} under {self.root}")
            number = numbers[-1]
        entry = json.loads(files.content(self.spark, f"{self._log(name)}/{number:012d}"))
        return Version(number, f"{self.root}/{layer_of(name)}/{name}/{entry['folder']}", entry["n_rows"])

    def write(self, name: str, df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        """Replace a table and return it as stored; writing the same rows again changes nothing.

        A job that fails, at any point, leaves the former table as it was. Raises ``ConcurrentWrite`` if
        another writer was faster.
        """
        if schema is not None:
            assert_schema(name, df, schema)
        before = self.versions(name)
        number = before[-1] + 1 if before else 1
        folder = f"version={number}-{uuid.uuid4().hex}"
        path = f"{self.root}/{layer_of(name)}/{name}/{folder}"
        n_rows = self._put(name, df, path)
        entry = json.dumps({"folder": folder, "n_rows": n_rows})
        if not files.create_once(self.spark, f"{self._log(name)}/{number:012d}", entry):
            files.remove(self.spark, path)
            raise ConcurrentWrite(f"{name}: version {number} was written meanwhile")
        if self.catalog:
            with self._catalog_lock:
                self._register(name, path, df.schema)
        for old in before[-2:-1]:
            files.remove(self.spark, self.version(name, old).folder)
        return self.read(name)

    def remove(self, name: str) -> None:
        """Remove a table with all its versions, once nothing reads it any more."""
        files.remove(self.spark, self._log(name))
        files.remove(self.spark, f"{self.root}/{layer_of(name)}/{name}")

    def _put(self, name: str, df: DataFrame, path: str) -> int:
        """Write the rows and count them on the way."""
        seen = Observation()
        rows = df
        if columns := RANGED.get(name):
            rows = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n_rows")).write
        if name in LOOKED_UP:
            writer = writer.option("parquet.block.size", ROW_GROUP_BYTES)
        writer.parquet(path)
        return seen.get.get("n_rows", 0)

    def _register(self, name: str, path: str, schema: T.StructType) -> None:
        layer = layer_of(name)
        table = f"{layer}.{name}"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
        if self.spark.catalog.tableExists(table) and self.spark.table(table).dtypes == [
            (f.name, f.dataType.simpleString()) for f in schema
        ]:
            self.spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
            self.spark.catalog.refreshTable(table)
        else:  # new, or with other columns
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.spark.catalog.createTable(table, path, "parquet")

    def read(self, name: str) -> DataFrame:
        """The current version of a table."""
        if self.catalog:
            return self.spark.table(f"{layer_of(name)}.{name}")
        return self.spark.read.parquet(self.version(name).folder)

    def view(self, name: str, df: DataFrame) -> DataFrame:
        """Staging frames stay unmaterialised, under their name as a temporary view."""
        df.createOrReplaceTempView(name)
        return df


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for intermediate files, in the shared folder the cluster names.

    That is ``spark.checkpoint.dir``. Only a local master may go without: it gets a temporary folder.
    On a file system that the driver sees the folder is removed when the process ends; in other stores
    the lifecycle rule of the shared folder does that.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        folder = f"{shared.rstrip('/')}/runout-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="runout-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if folder.startswith(("/", "file:")):
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder
