"""Steps that run at once, and what each frame reads."""

import threading
import time

import pytest
from planning_cases import SMALL

from runout.fixtures.order_tables import PARAMS
from runout.operators.staging import STAGING
from runout.plans import refresh as refreshing
from runout.plans.graph import StepsFailed, run_steps
from runout.plans.lineage import READS, Planning
from runout.plans.queries import planning
from runout.sources.sinks import Tables


def test_steps_run_after_what_they_read(spark):
    reads = {"c": ("a", "b"), "d": ("c",), "e": ("a", "elsewhere")}
    done = []
    run_steps(spark, {n: lambda n=n: done.append(n) for n in "dceba"}, reads)
    assert sorted(done) == list("abcde")
    for name, before in reads.items():
        assert all(done.index(b) < done.index(name) for b in before if b in done)


def test_steps_run_at_once_and_no_more_than_asked(spark):
    lock, now, most = threading.Lock(), [0], [0]

    def step():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1

    run_steps(spark, {str(i): step for i in range(12)}, {}, threads=3)
    assert most[0] == 3


def test_a_failure_stops_its_readers_only(spark):
    done = []

    def broken():
        raise ValueError("lost rows")

    steps = {n: lambda n=n: done.append(n) for n in ("a", "c", "d", "far")} | {"b": broken}
    reads = {"c": ("b",), "d": ("c",), "far": ("a",)}
    with pytest.raises(StepsFailed, match="b: ValueError: lost rows; not run: c, d") as e:
        run_steps(spark, steps, reads)
    assert sorted(done) == ["a", "far"] and set(e.value.errors) == {"b"} and e.value.skipped == ["c", "d"]


def test_jobs_of_several_steps_overlap(spark):
    spans = {}

    def slow(name):
        start = time.time()
        spark.range(200_000_000, numPartitions=2).selectExpr("sum(hash(id))").collect()
        spans[name] = (start, time.time())

    run_steps(spark, {n: lambda n=n: slow(n) for n in "xy"}, {}, threads=2)
    assert max(s for s, _ in spans.values()) < min(e for _, e in spans.values())


@pytest.mark.parametrize("name", list(READS))
def test_frames_read_what_is_declared(spark, name):
    """Composing one frame touches no frame and no extract that it is not declared to read."""
    direct = planning(spark, SMALL)
    composed, opened = [], set()

    class Opened(dict):
        def __getitem__(self, table):
            opened.add(table)
            return direct.extracts[table]

    plan = Planning(Opened(), direct.lanes, PARAMS, lambda table, df: composed.append(table) or df)
    frames = [r for r in READS[name] if not r.isupper()]
    for frame in frames:
        plan.__dict__[frame] = getattr(direct, frame)
    getattr(plan, name)
    assert len(composed) == 1
    assert opened == {r for r in READS[name] if r.isupper()}
    assert all(r.isupper() or r in READS for r in READS[name])
    # every declared frame is needed
    for frame in frames:
        short = Planning(Opened(), direct.lanes, PARAMS, lambda table, df: composed.append(table) or df)
        composed.clear()
        short.__dict__.update({f: getattr(direct, f) for f in frames if f != frame})
        getattr(short, name)
        assert len(composed) > 1, frame


def test_a_frame_that_fails_leaves_the_others_built(spark, tmp_path, monkeypatch):
    direct = planning(spark, SMALL)
    source, target, seed = (str(tmp_path / d) for d in ("extracts", "tables", "seed"))
    for table in direct.extracts:
        direct.extracts[table].write.option("header", True).option("escape", '"').csv(f"{source}/{table}_1.csv")
    direct.lanes.write.option("header", True).csv(seed)
    write = Tables.write

    def failing(self, name, df, schema=None):
        if name == "int_pn_infor":
            raise OSError("disk full")
        return write(self, name, df, schema)

    monkeypatch.setattr(Tables, "write", failing)
    with pytest.raises(StepsFailed, match="disk full") as e:
        refreshing.refresh(spark, source, target, PARAMS, seed)
    waiting = {n for n, r in READS.items() if "material_stock_context" in r}
    assert waiting <= set(e.value.skipped) and "model_tests" in e.value.skipped
    tables = Tables(spark, target)
    for name in ("mart_consumption", "int_sa_late_shipment", "int_backlog", "mart_vendor_performance", "load_audit"):
        assert tables.read(name).count() > 0
    assert not tables.versions("mart_shortage_report")
    assert set(STAGING) <= {t for t in direct.extracts if tables.versions(t)}
