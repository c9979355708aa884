"""The full run from CSV extracts, twice, against the same queries over the source tables."""

import json

import pytest
from planning_cases import SMALL
from pyspark.sql import functions as F

from runout.operators import quality
from runout.operators.staging import STAGING
from runout.plans.lineage import Planning
from runout.plans.queries import planning
from runout.plans.refresh import refresh, run_model_tests
from runout.fixtures.order_tables import PARAMS
from runout.sources.sinks import Tables


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    source, target, seed = (str(root / d) for d in ("extracts", "tables", "seed"))
    direct = planning(spark, SMALL)
    for table in direct.extracts:
        direct.extracts[table].write.option("header", True).option("escape", '"').csv(
            f"{source}/{table}/{table}_20000103.csv"
        )
    direct.lanes.write.option("header", True).csv(seed)

    def again():
        return refresh(spark, source, target, PARAMS, seed)

    return direct, again, target


def test_refresh_twice(spark, run):
    direct, again, target = run
    for _ in range(2):
        plan = again()
    for name in ("shortage_report", "vendor_performance", "consumption", "backlog"):
        got, want = getattr(plan, name), getattr(direct, name).select(getattr(plan, name).columns)
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0

    tables = Tables(spark, target)
    stored = tables.read("mart_inventory_simulation")
    assert stored.count() == 121 * plan.shortage_report.count()
    assert stored.exceptAll(direct.inventory_simulation.select(stored.columns)).count() == 0

    tests = tables.read("mart_model_tests").collect()
    assert len(tests) == 29
    failed = {r.rule for r in tests if r.n_violations}
    assert failed == set()
    assert tables.read("mart_model_test_rows").count() == 0

    audit = {
        r.table_name: r.n_rows
        for r in tables.read("load_audit").collect()
    }
    assert audit["EKET"] == direct.extracts["EKET"].count()
    assert audit["total"] == sum(n for t, n in audit.items() if t != "total")
    for table in STAGING:
        assert spark.table(f"stg_{table.lower()}").columns == plan.stg(table).columns


def test_broken_rules_are_stored_with_their_rows(spark, run, tmp_path, monkeypatch):
    direct, _, _ = run
    plan = Planning(direct.extracts, direct.lanes, PARAMS)
    marc, report = plan.stg("MARC"), plan.shortage_report
    first = F.col("marc_id") == marc.agg(F.min("marc_id")).first()[0]
    broken = {
        "stg_marc": marc.withColumn("procurement_type", F.when(first, "Z").otherwise(F.col("procurement_type"))),
        "mart_shortage_report": report.withColumn("red_days", F.lit(-1)).unionAll(report.where(first)),
    }
    whole = Planning.model_tables
    monkeypatch.setattr(Planning, "model_tables", lambda self, names: {**whole(self, names), **broken})
    tables = Tables(spark, str(tmp_path))
    run_model_tests(plan, tables)
    n = {r.rule: r.n_violations for r in tables.read("mart_model_tests").collect()}
    assert len(n) == 29
    rows = tables.read("mart_model_test_rows").collect()
    assert {r.rule for r in rows} == {rule for rule, count in n.items() if count}
    materials = report.count()
    one = json.dumps({"marc_id": marc.agg(F.min("marc_id")).first()[0]}, separators=(",", ":"))
    assert n["red_days not negative"] == materials
    assert n["unique mart_shortage_report.marc_id"] == 1
    assert [r.key for r in rows if r.rule == "unique mart_shortage_report.marc_id"] == [one]
    assert [(r.key, r.n) for r in rows if r.rule == "accepted_values stg_marc.procurement_type"] == [
        ('{"procurement_type":"Z"}', 1)
    ]
    assert sum(r.rule == "red_days not negative" for r in rows) == materials
    few = quality.shown(tables.read("mart_model_test_rows"), 3)
    assert few.where("rule = 'red_days not negative'").count() == 3


def test_missing_extract_is_an_error(spark, run, tmp_path):
    direct, _, _ = run
    direct.extracts["T001W"].write.option("header", True).csv(
        str(tmp_path / "T001W/T001W_20000103.csv")
    )
    with pytest.raises(FileNotFoundError, match="EKET"):
        refresh(spark, str(tmp_path), str(tmp_path / "out"), PARAMS, "unused")


def test_every_tested_table_is_known():
    names = {*quality.UNIQUE, *quality.UNIQUE_COMBINATIONS, *quality.NOT_NULL}
    assert {t for t, _ in quality.ACCEPTED_VALUES} <= names | {
        "stg_vbup",
        "int_inbound_deliveries_asn",
    }
