import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from planning_cases import as_dicts
from pyspark.sql import functions as F

from runout.sources.extracts import bronze_read, extract_latest, load, load_audit, read_extracts
from runout.sources.lanes import lane_matrix, read_lanes
from runout.sources.schemas import EXTRACTS, LANES
from runout.sources import sinks
from runout.sources.sinks import ConcurrentWrite, Tables, scratch_folder


def put(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(content)
    return full


@pytest.fixture
def root(tmp_path):
    put(tmp_path, "LFA1/LFA1_20000102.csv", "LIFNR,LAND1\n0000000009,XX\n")
    put(tmp_path, "LFA1/LFA1_20000103.csv",
        'LAND1,LIFNR,NAME1\nDE,0000000001,"Smith, ""Bob"""\nNA,0000000002,""\n,0000000003,x\n')
    put(tmp_path, "deep/er/T001W_20000103.csv", "werks,fabkl\n1000,01\n")
    put(tmp_path, "TFACT/TFACT_20000103.csv/part-00000.csv", "ident,spras\n01,E\n")
    put(tmp_path, "TFACT/TFACT_20000103.csv/part-00001.csv", "ident,spras\n02,E\n")
    put(tmp_path, "LFA1/readme.txt", "no extract")
    return str(tmp_path)


def test_latest_extract_wins(spark, root):
    got = {r.table_name: r.stamp for r in extract_latest(spark, root).collect()}
    assert got == {"LFA1": "20000103", "T001W": "20000103", "TFACT": "20000103"}


def test_everything_is_text_by_name(spark, root):
    lfa1 = read_extracts(spark, root)["LFA1"]
    assert lfa1.schema == EXTRACTS["LFA1"]
    got = {r["lifnr"]: r for r in as_dicts(lfa1)}
    assert got["0000000001"]["land1"] == "DE"  # header order does not matter
    assert got["0000000001"]["name1"] == 'Smith, "Bob"'
    assert got["0000000002"]["name1"] is None  # a quoted empty field is missing too
    assert got["0000000002"]["land1"] == "NA"  # a country, not a missing value
    assert got["0000000003"]["land1"] is None
    assert got["0000000003"]["regio"] is None  # declared, not in the file


def test_na_values_on_request(spark, root):
    lfa1 = read_extracts(spark, root, na_values=["NA"])["LFA1"]
    assert {r.lifnr: r.land1 for r in lfa1.collect()}["0000000002"] is None


def test_part_files_are_one_extract(spark, root):
    assert read_extracts(spark, root)["TFACT"].count() == 2


def test_undeclared_names_are_errors(spark, root):
    path = put(root, "EKKO/EKKO_1.csv", "ebeln,colour\n1,red\n")
    with pytest.raises(ValueError, match="colour"):
        bronze_read(spark, "EKKO", path)
    put(root, "ZZZZ/ZZZZ_1.csv", "a\n1\n")
    with pytest.raises(ValueError, match="ZZZZ"):
        read_extracts(spark, root)


def test_names_without_a_stamp_are_loaded(spark, tmp_path):
    put(tmp_path, "KNA1.csv", "KUNNR,LAND1\n0000000007,DE\n")
    put(tmp_path, "x/MARA.csv/part-0.csv", "matnr\n1\n")
    put(tmp_path, "LFA1.csv", "lifnr\nold\n")
    put(tmp_path, "LFA1_2000_01.csv", "lifnr\nnew\n")
    got = read_extracts(spark, str(tmp_path))
    assert got["KNA1"].select("kunnr", "land1").first() == ("0000000007", "DE")
    assert got["MARA"].count() == 1
    assert [r.lifnr for r in got["LFA1"].collect()] == ["new"]


@pytest.mark.parametrize("name", ["notes.csv", "lfa1_1.csv", "deep/notes_1.csv/part-0.csv"])
def test_files_of_no_table_are_errors(spark, root, name):
    put(root, name, "a\n1\n")
    with pytest.raises(ValueError, match="undeclared"):
        read_extracts(spark, root)


def test_part_files_with_another_header_are_errors(spark, root):
    put(root, "EKKO/EKKO_1.csv/part-0.csv", "lifnr,ebeln\n0000000001,1\n")
    path = put(root, "EKKO/EKKO_1.csv/part-1.csv", "ebeln,lifnr\n2,0000000002\n")
    with pytest.raises(Exception, match="header"):
        bronze_read(spark, "EKKO", os.path.dirname(path)).collect()


@pytest.mark.parametrize(
    "rows", ["1,x,extra\n", "1\n", '1,"broken\nin two"\n', '"00\n1",x\n'], ids=["more", "fewer", "quoted", "first"]
)
@pytest.mark.parametrize("read", ["all", "one column", "count"])
def test_rows_that_do_not_fit_the_header_are_errors(spark, root, rows, read):
    path = put(root, "EKKO/EKKO_1.csv", f"ebeln,ekorg\n0,y\n{rows}")
    df = bronze_read(spark, "EKKO", path)
    with pytest.raises(Exception, match="(?i)malformed"):
        {"all": df.collect, "one column": df.select("ebeln").collect, "count": df.count}[read]()


def test_multi_line_fields(spark, root):
    path = put(root, "EKKO/EKKO_1.csv", 'ebeln,ekorg\n1,"10\n00"\n')
    assert bronze_read(spark, "EKKO", path, multi_line=True).first().ekorg == "10\n00"


def test_audit_is_what_the_load_counted(spark, root, tmp_path):
    tables = Tables(spark, str(tmp_path / "out"))
    extracts = read_extracts(spark, root)
    extracts["KNA1"] = spark.createDataFrame([], EXTRACTS["KNA1"])
    loaded = load(tables, extracts)
    audit = {r.table_name: r.n_rows for r in load_audit(tables, loaded).collect()}
    assert audit == {"KNA1": 0, "LFA1": 3, "T001W": 1, "TFACT": 2, "total": 6}
    assert {t: df.count() for t, df in loaded.items()} == {t: n for t, n in audit.items() if t != "total"}
    assert "FileScan" not in load_audit(tables, loaded)._jdf.queryExecution().toString()


@pytest.mark.parametrize("catalog", [False, True])
def test_refresh_replaces_the_table(spark, root, tmp_path, catalog):
    lfa1 = read_extracts(spark, root)["LFA1"]
    tables = Tables(spark, str(tmp_path / "out"), catalog)
    for _ in range(2):
        stored = tables.write("LFA1", lfa1, EXTRACTS["LFA1"])
        assert stored.count() == 3
    assert tables.write("LFA1", lfa1.limit(1), EXTRACTS["LFA1"]).count() == 1
    with pytest.raises(ValueError, match="schema"):
        tables.write("LFA1", lfa1.drop("land1"), EXTRACTS["LFA1"])
    assert tables.read("LFA1").count() == 1  # refused before anything was replaced
    failing = lfa1.withColumn("regio", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.write("LFA1", failing, EXTRACTS["LFA1"])
    assert tables.read("LFA1").count() == 1  # the failed job left the table as it was
    if catalog:
        assert spark.table("bronze.LFA1").count() == 1


def test_a_failed_switch_keeps_the_old_rows(spark, frame, tmp_path, monkeypatch):
    """Rows that are written but not yet in the log do not exist; former readers can finish."""
    tables = Tables(spark, str(tmp_path))
    first = tables.write("x", frame("a int", [(1,)]))
    monkeypatch.setattr(Tables, "_log", lambda self, name: f"{self.root}/nowhere\0")
    with pytest.raises(Exception):  # noqa: B017 - whatever the file system says
        tables.write("x", frame("a int", [(2,), (3,)]))
    monkeypatch.undo()
    assert [r.a for r in tables.read("x").collect()] == [1]
    assert tables.write("x", frame("a int, b int", [(4, 5)])).collect() == [(4, 5)]
    assert [r.a for r in first.collect()] == [1]
    assert len(tables.versions("x")) == 2
    with pytest.raises(FileNotFoundError, match="never"):
        tables.read("never")


def test_the_second_of_two_writers_is_refused(spark, frame, tmp_path):
    slow, fast = Tables(spark, str(tmp_path)), Tables(spark, str(tmp_path))
    slow.write("x", frame("a int", [(0,)]))
    put_rows = slow._put

    def overtaken(name, df, path):
        n = put_rows(name, df, path)
        fast.write("x", frame("a int", [(2,), (3,)]))
        fast.write("x", frame("a int", [(4,)]))
        return n

    slow._put = overtaken
    with pytest.raises(ConcurrentWrite, match="version 2"):
        slow.write("x", frame("a int", [(1,)]))
    assert [r.a for r in slow.read("x").collect()] == [4]
    assert slow.versions("x") == [1, 2, 3]
    kept = [d for d in os.listdir(tmp_path / "bronze/x") if d.startswith("version=")]
    assert sorted(d.split("-")[0] for d in kept) == ["version=2", "version=3"]  # the refused rows are gone


def test_many_writers_at_once_leave_one_whole_table(spark, frame, tmp_path):
    def write(i):
        try:
            Tables(spark, str(tmp_path)).write("x", frame("a int", [(i,)] * (i + 1)))
            return i
        except ConcurrentWrite:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [i for i in pool.map(write, range(6)) if i is not None]
    tables = Tables(spark, str(tmp_path))
    assert won and tables.versions("x") == list(range(1, len(won) + 1))
    rows = [r.a for r in tables.read("x").collect()]
    assert rows == [rows[0]] * (rows[0] + 1) and rows[0] in won
    assert tables.version("x").n_rows == len(rows)


def rows_scanned(df):
    """Rows that the scans of a collected frame handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_material_is_read_from_few_row_groups(spark, tmp_path, monkeypatch):
    """The rows scanned for one material do not grow with the materials there are."""
    monkeypatch.setattr(sinks, "ROW_GROUP_BYTES", 4096)
    scanned = []
    for n in (500, 5000):
        tables = Tables(spark, str(tmp_path / str(n)))
        number = F.col("id") % n * 7919 % 1_000_003
        runs = spark.range(n * 60).select(
            F.format_string("%018d", number).alias("marc_id"),
            F.floor(F.col("id") / n).cast("int").alias("day"),
            F.rand(1).alias("simulated_inventory_qty"),
        )
        runs = tables.write("int_stock_runs", runs)
        simulated = tables.write("mart_inventory_simulation", runs)
        one = simulated.where(F.col("marc_id") == f"{7919:018d}")
        assert one.count() == 60
        scanned.append(rows_scanned(one))
    assert 60 <= scanned[0] and scanned[1] <= 1.5 * scanned[0] + 200 and scanned[1] < 5000 * 60 / 20


def test_scratch_folders_are_shared_or_local():
    shared = {}

    class Elsewhere:
        conf = type("Conf", (), {"get": lambda self, key, default: shared.get(key, default)})()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_folder(Elsewhere)
    Elsewhere.sparkContext.master = "local[2]"
    assert os.path.isdir(scratch_folder(Elsewhere))
    shared["spark.checkpoint.dir"] = "hdfs://store/shared/"
    assert scratch_folder(Elsewhere).startswith("hdfs://store/shared/runout-")


def test_lanes_keep_leading_zeros(spark, tmp_path):
    path = put(tmp_path, "seed.csv", "lifnr,ekorg,werks,transit_time_days\n0000000001,1000,0100,3\n")
    lanes = read_lanes(spark, path)
    assert lanes.schema == LANES
    assert tuple(lanes.first()) == ("0000000001", "1000", "0100", 3)


def test_lanes_are_read_by_name(spark, tmp_path):
    path = put(tmp_path, "seed.csv", "EKORG,transit_time_days,LIFNR,werks\n1000,3,0000000001,0100\n")
    lanes = read_lanes(spark, path)
    assert lanes.schema == LANES
    assert tuple(lanes.first()) == ("0000000001", "1000", "0100", 3)


@pytest.mark.parametrize(
    "row", ["1,1000,0100,3,extra", "1,1000,0100", '1,"10\n00",0100,3'], ids=["more", "fewer", "broken"]
)
@pytest.mark.parametrize("read", ["all", "one column", "count"])
def test_lanes_that_do_not_fit_are_errors(spark, tmp_path, row, read):
    path = put(tmp_path, "seed.csv", f"lifnr,ekorg,werks,transit_time_days\n0,1000,0100,3\n{row}\n")
    df = read_lanes(spark, path)
    with pytest.raises(Exception, match="(?i)malformed"):
        {"all": df.collect, "one column": df.select("lifnr").collect, "count": df.count}[read]()


@pytest.mark.parametrize("days", ["x7", "3.5", "99999999999"])
def test_days_that_are_no_whole_numbers_are_errors(spark, tmp_path, days):
    path = put(tmp_path, "seed.csv", f"lifnr,ekorg,werks,transit_time_days\n0,1000,0100,3\n1,1000,0100,{days}\n")
    df = read_lanes(spark, path)
    for read in (df, df.select("transit_time_days")):
        with pytest.raises(Exception, match="(?i)malformed"):
            read.collect()


@pytest.mark.parametrize("header", ["lifnr,ekorg,werks", "lifnr,ekorg,werks,days", "lifnr,ekorg,werks,transit_time_days,x"])
def test_seed_headers_other_than_declared_are_errors(spark, tmp_path, header):
    path = put(tmp_path, "seed.csv", f"{header}\n" + ",".join("1" * len(header.split(","))) + "\n")
    with pytest.raises(ValueError, match="declared"):
        read_lanes(spark, path)


def test_lane_matrix(frame):
    vendors = frame("lifnr string, land1 string", [("1", "DE"), ("1", "DE"), ("2", "CN")])
    lanes = lane_matrix(vendors)
    assert lanes.dtypes == [(f.name, f.dataType.simpleString()) for f in LANES]
    got = {(r.lifnr, r.werks): r.transit_time_days for r in lanes.collect()}
    assert got == {
        ("1", "1000"): 3, ("1", "1001"): 4, ("1", "1002"): 5, ("1", "1003"): 4,
        ("2", "1000"): 28, ("2", "1001"): 29, ("2", "1002"): 30, ("2", "1003"): 29,
    }


def test_unknown_country_is_an_error(frame):
    with pytest.raises(Exception, match="no transit days for country XX"):
        lane_matrix(frame("lifnr string, land1 string", [("1", "XX")])).collect()


def test_a_removed_table_is_gone_and_can_be_written_again(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    for n in (3, 4):
        tables.write("int_once", spark.range(n))
        tables.write("int_twice", spark.range(n))
    tables.remove("int_once")
    assert tables.versions("int_once") == [] and not (tmp_path / "intermediate/int_once").exists()
    with pytest.raises(FileNotFoundError):
        tables.read("int_once")
    assert tables.read("int_twice").count() == 4
    assert tables.write("int_once", spark.range(5)).count() == 5
