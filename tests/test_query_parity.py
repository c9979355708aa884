"""Every registered query against its DuckDB statement on the smallest tables."""

import sys
from pathlib import Path

import pytest
from planning_cases import SMALL

import __spark_entry__ as contract
from runout.plans.oracles import ORACLES
from runout.plans.queries import QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import connect, difference  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_a_statement():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees(spark, con, name):
    problem, *_ = difference(spark, con, SMALL, name)
    assert problem == ""


CHECKS = (
    "dq_unique dq_not_null dq_accepted_values dq_unique_combo dq_rate_range dq_null_projection"
    " dq_negative_transit dq_negative_red_days pk_nulls date_format constant_value over_receipt"
    " early_receipt asn_status_conflict open_qty_positive"
).split()


@pytest.mark.parametrize("name", CHECKS)
def test_every_check_finds_its_faults(con, name):
    counts = dict(con.execute(ORACLES[name]).fetchall())
    assert all(counts.values()), counts


def test_entry(spark):
    report = contract.entry(spark)
    assert {r.status for r in report.select("status").collect()} == {"Shortage", "No Shortage"}
