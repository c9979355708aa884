"""The full daily run: load the latest extracts, rebuild every table, test the result."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from runout.operators import quality
from runout.operators.staging import STAGING
from runout.params import Params
from runout.plans.graph import THREADS, run_steps
from runout.plans.lineage import READS, Planning
from runout.session import tune
from runout.sources.extracts import load_audit, read_extracts
from runout.sources.lanes import read_lanes
from runout.sources.schemas import EXTRACTS, LANES
from runout.sources.sinks import Tables, scratch_folder

#: Frames that the model tests read, beside staging.
TESTED = (
    "material_stock_context",
    "factory_calendar",
    "working_calendar",
    "asn_status",
    "transit_quota",
    "shortage_report",
    "inventory_simulation",
    "consumption",
    "vendor_performance",
)


def refresh(
    spark: SparkSession,
    source: str,
    target: str,
    params: Params,
    lanes_path: str,
    catalog: bool = False,
    na_values: Iterable[str] = (),
    multi_line: bool = False,
    threads: int = THREADS,
) -> Planning:
    """Rebuild all tables under ``target`` from the extracts under ``source``.

    Every table is written once and read back, so each step starts from stored data and a lost executor
    costs no more than the step at hand. Tables that do not wait for each other are built at once, up to
    ``threads`` of them; a table that fails stops only those that read it, and is reported at the end.
    Running it again replaces the same tables. ``multi_line`` reads extracts with line breaks inside quoted
    fields.
    """
    tune(spark)
    tables = Tables(spark, target, catalog)
    found = read_extracts(spark, source, na_values, multi_line)
    missing = sorted(set(STAGING) - set(found))
    if missing:
        raise FileNotFoundError(f"no extract of {missing} under {source}")
    lanes = tables.write("seed_transit_time", read_lanes(spark, lanes_path), LANES)
    bronze: dict[str, DataFrame] = {}
    plan = Planning(bronze, lanes, params, tables.write)

    def load(table: str) -> None:
        bronze[table] = tables.write(table, found[table], EXTRACTS[table])
        if table in STAGING:
            tables.view(f"stg_{table.lower()}", plan.stg(table))

    steps: dict[str, Callable[[], object]] = {t: lambda t=t: load(t) for t in found}
    steps |= {name: lambda name=name: getattr(plan, name) for name in READS}
    steps["load_audit"] = lambda: tables.write("load_audit", load_audit(tables, found))
    steps["model_tests"] = lambda: run_model_tests(plan, tables)
    reads = {**READS, "load_audit": tuple(found), "model_tests": (*TESTED, *STAGING)}
    run_steps(spark, steps, reads, threads)
    return plan


def run_model_tests(plan: Planning, tables: Tables) -> None:
    """Store the result of every model test and the rows that break one; a rule with violations has failed."""
    found = quality.model_violations(plan.model_tables(quality.model_rules()))
    folder = scratch_folder(tables.spark)
    found.write.parquet(folder)
    found = tables.spark.read.schema(found.schema).parquet(folder)
    tables.write("mart_model_tests", quality.model_tests(found))
    tables.write("mart_model_test_rows", quality.shown(found))
