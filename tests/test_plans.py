"""Physical plans: what must not appear at scale, and what must be pushed down."""

import re
import time

import pytest
from planning_cases import SMALL
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

import __spark_entry__ as contract
from runout.operators import integrity, quality
from runout.operators.purchasing import late_shipment
from runout.operators.supply import supply_gap_fill
from runout.plans import queries
from runout.plans.queries import QUERIES, edge, planning, stored_planning
from runout.session import SHUFFLE_CLEANUP
from runout.sources.sinks import Tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [q for q in QUERIES if q != "extract_latest"])
def test_no_cross_join_python_or_global_window(spark, name):
    plan = plan_of(contract.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    # a window without partition keys would gather everything in one task
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        assert not re.match(r"[^,]* (ASC|DESC)", spec), spec


def without_broadcast(spark, build):
    """The plan when nothing is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan_of(build())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    "name", ["shortage_report", "late_shipment", "supply_gap_fill", "asn_status", "backlog"]
)
def test_nothing_is_broadcast_regardless_of_size(spark, name):
    plan = without_broadcast(spark, lambda: contract.queries()[name](spark, SMALL))
    assert "Broadcast" not in plan
    assert "CartesianProduct" not in plan


def test_projection_is_unfolded_after_the_last_exchange(spark):
    """The 121 days per material are never shuffled, sorted or joined."""
    plan = plan_of(planning(spark, SMALL).inventory_simulation)
    above = plan[: plan.index("Generate explode(sequence(day")]
    assert not re.search(r"Exchange|Sort|Join|Aggregate|Window", above)


def test_report_does_not_build_the_daily_rows(spark):
    assert "sequence(day" not in plan_of(planning(spark, SMALL).shortage_report)


def test_report_aggregates_where_the_window_left_the_rows(spark):
    """One exchange by material serves the window, the join and the aggregate."""
    plan = without_broadcast(spark, lambda: planning(spark, SMALL).shortage_report.select("*"))
    above_window = plan[: plan.index("Window")]
    assert "Exchange" not in above_window


def test_gap_fill_days_are_not_joined(spark):
    plan = plan_of(planning(spark, SMALL).supply_gap_fill)
    above = plan[: plan.index("array_except")]
    assert "Exchange" not in above and "Join" not in above


def test_gap_fill_reads_the_supply_once_and_broadcasts_no_days(spark, tmp_path):
    """The days of a pair are gathered with its parties: over a stored context nothing is joined by pair, and
    pairs are unfolded in a number of tasks that Spark does not merge by their size before."""
    p = planning(spark, SMALL)
    spark.createDataFrame([], p.supply_context.schema).write.parquet(f"{tmp_path}/context")
    context = spark.read.parquet(f"{tmp_path}/context")
    plan = plan_of(supply_gap_fill(context, p.calendar_index, p.params))
    assert plan.count("FileScan parquet") == 2  # the context and the plants
    assert plan.count("BroadcastExchange") == 1  # the calendars
    below = plan[plan.index("array_except") :]
    assert f", {quality.KEY_TASKS}), REPARTITION_BY_NUM" in below


@pytest.mark.parametrize("name", ["supply", "supply_context"])
def test_supply_derives_the_deliveries_once(spark, name):
    """They are stored first, so that the plan over them derives no delivery again."""
    found = contract.queries()[name](spark, SMALL)
    assert "l_tax" not in plan_of(found)  # only the deliveries depend on it
    assert any("int_announced" in file for file in found.inputFiles())


def test_vendors_named_twice_do_not_cover_a_line_twice(spark, tmp_path):
    """Over stored deliveries as over lazy ones: coverage needs the vendor's number, not its names."""
    for name in ("nation", "supplier", "part", "lineitem"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        table = table.unionAll(table) if name == "supplier" else table
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    lazy = planning(spark, str(tmp_path)).supply
    assertDataFrameEqual(contract.queries()["supply"](spark, str(tmp_path)), edge(lazy))


def test_quota_headers_are_derived_once(spark):
    """Lines to headers, to items and to the items' total; before, to the number of headers too."""
    plan = planning(spark, SMALL).quota_share._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^]]*l_orderkey", plan)) == 3


def test_small_shuffled_sides_are_hashed_not_sorted(spark):
    def rows(n):
        return spark.range(n).selectExpr("lpad(cast(id AS string), 18, '0') AS id", "id AS v")

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = rows(2000).join(rows(1000).withColumnRenamed("v", "w"), "id", "left")
        found = joined.collect()
        assert len(found) == 2000 and sum(r.w is not None for r in found) == 1000
        plan = plan_of(joined)
        assert "ShuffledHashJoin" in plan[: plan.index("Initial Plan")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_demand_is_reduced_before_it_is_shuffled(spark):
    plan = plan_of(planning(spark, SMALL).consumption)
    scans = plan.count("partial_sum(demand_qty")
    assert scans == 1
    assert plan.index("partial_sum(demand_qty") < plan.index("Union")


def test_material_filter_reaches_the_stored_projection(spark, tmp_path):
    path = str(tmp_path / "sim")
    planning(spark, SMALL).inventory_simulation.write.parquet(path)
    one = spark.read.parquet(path).where(F.col("marc_id") == "x").select("calendar_date")
    assert "EqualTo(marc_id,x)" in plan_of(one)


def test_scans_read_the_needed_columns_only(spark):
    plan = contract.queries()["consumption_trend"](spark, SMALL)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan._jdf.queryExecution().toString())
    assert schemas
    for schema in schemas:
        assert "l_extendedprice" not in schema and "l_discount" not in schema


def test_order_items_are_not_shuffled_by_their_few_lanes(spark, tmp_path):
    """Over stored extracts the lanes' size is known, so they are broadcast."""
    plan = plan_of(stored_planning(spark, SMALL, str(tmp_path)).po_transit_quota)
    for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan):
        names = {re.sub(r"#\d+", "", k.strip()) for k in keys.split(",")}
        assert not names >= {"vendor_number", "plant", "purchasing_org"}
    large = without_broadcast(
        spark, lambda: stored_planning(spark, SMALL, str(tmp_path)).po_transit_quota.select("*")
    )
    assert "Broadcast" not in large


def test_coverage_has_no_lambda(spark):
    p = planning(spark, SMALL)
    lines, deliveries = (
        spark.createDataFrame([], df.schema) for df in (p.open_schedule, p.future_deliveries)
    )
    plan = late_shipment(lines, deliveries, p.params)._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan
    # lines are looked up, not sorted into or searched in the days: arrays are only sorted once per pair
    assert plan.count("sort_array(") == 1 and "collect_list" in plan[plan.index("sort_array(") :][:60]
    assert not any(name in plan for name in ("array_append", "array_position", "array_insert"))


@pytest.mark.parametrize(("name", "tables"), [("pk_duplicates", 14), ("fk_orphans", 10), ("fk_orphans_composite", 6)])
def test_key_checks_read_each_table_once(spark, tmp_path, name, tables):
    """One scan a table and, combined map-side, one exchange of keys and one of rules."""
    extracts = stored_planning(spark, SMALL, str(tmp_path)).extracts
    plan = plan_of(getattr(integrity, name)(extracts))
    assert plan.count("FileScan parquet") == tables
    assert plan.count("Exchange hashpartitioning(rule#") == 3
    keyed = plan[plan.index("Exchange hashpartitioning(rule#") :]
    assert "partial_sum(n#" in keyed


@pytest.mark.parametrize("name", ["pk_duplicates", "fk_orphans", "fk_orphans_composite"])
def test_key_checks_hold_no_keys_where_they_are_read(spark, tmp_path, name):
    """Nearly unique keys are counted behind a shuffle to a number of tasks that Spark does not merge."""
    extracts = stored_planning(spark, SMALL, str(tmp_path)).extracts
    plan = plan_of(getattr(integrity, name)(extracts))
    dealt = plan[plan.index("Exchange hashpartitioning(rule#", plan.index("partial_sum(n#")) :]
    assert re.match(rf"[^\n]*, {quality.KEY_TASKS}\), REPARTITION_BY_NUM", dealt)
    assert "Aggregate" not in dealt


@pytest.mark.parametrize("session", [4, quality.KEY_TASKS, quality.KEY_TASKS + 1, 400])
def test_combinations_are_dealt_bare_by_their_first_column(spark, tmp_path, session):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.range(9).selectExpr("id AS a", "id AS b").write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.shuffle.partitions", str(session))
    try:
        rows = spark.read.parquet(f"{tmp_path}/t").repartition("a")
        found = plan_of(quality.violations(rows, [quality.unique_rule("t", "a", "b")]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (tasks,) = re.findall(r"hashpartitioning\(a#\d+L?, (\d+)\), REPARTITION_BY_NUM", found)
    assert int(tasks) != session and int(tasks) >= min(quality.KEY_TASKS, session) - 1
    assert "Aggregate" not in found[found.index("REPARTITION_BY_NUM") :]


def test_model_tests_read_each_table_once(spark, tmp_path):
    plan = stored_planning(spark, SMALL, str(tmp_path))
    empty = {t: spark.createDataFrame([], df.schema) for t, df in plan.model_tables(quality.model_rules()).items()}
    for table, df in empty.items():
        df.write.parquet(f"{tmp_path}/tested/{table}")
    tested = {t: spark.read.parquet(f"{tmp_path}/tested/{t}") for t in empty}
    found = plan_of(quality.model_violations(tested))
    assert found.count("FileScan parquet") == len(tested) == 14


def test_composing_the_detail_supply_writes_nothing(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    plan = planning(spark, SMALL)
    lazy = type(plan)(plan.extracts, plan.lanes, plan.params)
    monkeypatch.setattr(DataFrameWriter, "parquet", None)
    assert "array_except" in plan_of(lazy.detail_supply)


def test_detail_supply_reads_its_context_once_composed(spark):
    plan = plan_of(QUERIES["detail_supply"](spark, SMALL))
    scanned = set(re.findall(r"FileScan parquet.*?Location: InMemoryFileIndex\([^)]*\)\[([^\]]*)\]", plan))
    assert not any("lineitem" in path for path in scanned)


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_")}


def test_detail_supply_leaves_its_context_and_no_shuffles(spark, tmp_path, monkeypatch):
    """Disk holds one step's shuffles and the tables still to be read, not those of all steps."""
    write, held = Tables.write, {}

    def noted(self, name, *given):
        stored = write(self, name, *given)
        held[name] = {p.name for p in tmp_path.glob("*/*") if p.parent.name != "_log"}
        return stored

    monkeypatch.setattr(Tables, "write", noted)
    monkeypatch.setattr(queries, "scratch_folder", lambda spark: str(tmp_path))
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    QUERIES["detail_supply"](spark, SMALL)
    for _ in range(100):  # files are removed in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert {p.name for p in tmp_path.glob("*/*") if p.parent.name != "_log"} == {"int_partial_detail_supply"}
    assert held["int_supply"] == {"MARC", "int_announced", "int_tt_quota", "int_sa_future", "int_supply"}
    assert max(map(len, held.values())) == 5


def test_detail_supply_steps_have_the_rows_of_the_lazy_frames(spark, tmp_path):
    """Also where master data is named twice, which multiplies rows."""
    for name in ("nation", "supplier", "part", "lineitem"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        table = table.unionAll(table) if name == "supplier" else table
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    found = contract.queries()["detail_supply"](spark, str(tmp_path))
    lazy = edge(planning(spark, str(tmp_path)).detail_supply)
    hashed = [
        df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first() for df in (found, lazy)
    ]
    assert found.columns == lazy.columns and hashed[0] == hashed[1] and hashed[0][0] > 0


def test_top_share_grows_by_a_constant_per_step(spark):
    plan = plan_of(QUERIES["pareto_share"](spark, SMALL))
    assert plan.count("FileScan") <= 6 and plan.count("BroadcastExchange") <= 5
