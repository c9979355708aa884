from decimal import Decimal

import pytest
from planning_cases import ANCHOR, as_dicts
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runout.functions.columns import joined_id, parse_date, whole
from runout.operators.staging import STAGING, stage
from runout.sources.schemas import EXTRACTS


def test_dates_from_text(frame):
    df = frame("x string", [("20000103",), ("",), (None,), ("2000-1-3",), ("20001301",)])
    assert [r[0] for r in df.select(parse_date("x")).collect()] == [ANCHOR, None, None, None, None]


def test_nearest_integer_not_truncation(frame):
    df = frame("x decimal(10,2)", [(Decimal("2.5"),), (Decimal("2.49"),), (None,)])
    assert [r[0] for r in df.select(whole("x")).collect()] == [3, 2, None]


def test_joined_id_is_null_with_a_null_part(frame):
    df = frame("a string, b string", [("M", "1"), (None, "1"), ("M", None)])
    assert [r[0] for r in df.select(joined_id("a", "b")).collect()] == ["M-1", None, None]


def test_every_staged_field_is_declared(spark):
    for table, columns in STAGING.items():
        staged = stage(table, spark.createDataFrame([], EXTRACTS[table]))
        assert len(set(staged.columns)) == len(columns())


def test_staging_types(frame):
    names = EXTRACTS["EKET"].fieldNames()
    values = {"ebeln": "0000000001", "ebelp": "00010", "eindt": "20000103", "menge": "1.005"}
    eket = frame(", ".join(f"{n} string" for n in names), [tuple(values.get(n) for n in names)])
    row = as_dicts(stage("EKET", eket))[0]
    assert row["ekpo_id"] == "0000000001-00010"
    assert row["delivery_date"] == ANCHOR
    assert row["scheduled_quantity"] == Decimal("1.01")
    assert row["open_quantity"] is None  # received quantity is missing


def test_bad_quantities_are_errors(frame):
    names = EXTRACTS["EKET"].fieldNames()
    bad = {"menge": "many"}
    eket = frame(", ".join(f"{n} string" for n in names), [tuple(bad.get(n) for n in names)])
    with pytest.raises(PySparkException):
        stage("EKET", eket).agg(F.sum("scheduled_quantity")).collect()
