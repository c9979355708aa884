from datetime import date
from decimal import Decimal

import pytest
from planning_cases import as_dicts

from runout.operators import serving


@pytest.fixture(scope="module")
def report(frame):
    rows = [
        ("a", "0001", "1000", "A", "Shortage", 5, 9, 10),
        ("b", "0002", "1000", "B", "No Shortage", 0, 9, 0),
        ("c", "0013", "1001", "A", "Shortage", 5, 20, 5),
        ("d", None, None, None, "No Shortage", 0, 0, 0),
    ]
    return frame(
        "marc_id string, material_number string, plant string, abc_class string, status string,"
        " red_days_in_tt bigint, red_days bigint, overdue_backlog_qty decimal(28,4)",
        [(*r[:-1], Decimal(r[-1])) for r in rows],
    )


@pytest.fixture(scope="module")
def vendors(frame):
    return frame(
        "vendor_number string, vendor_name string, otd_rate decimal(10,3),"
        " late_qty_due decimal(20,2)",
        [
            ("1", "One", Decimal("0.85"), Decimal(1)),
            ("2", "Two", None, Decimal(2)),
            ("3", "Three", Decimal("0.6"), Decimal(4)),
            ("4", "Four", Decimal("0.599"), Decimal(0)),
        ],
    )


def ids(df, column="marc_id"):
    return [r[column] for r in df.collect()]


def test_ranked_by_red_days(report):
    assert ids(serving.shortage_ranked(report)) == ["c", "a", "b", "d"]


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({}, "abcd"),
        ({"plant": "1000"}, "ab"),
        ({"abc_class": "A", "status": "Shortage"}, "ac"),
        ({"search": "00.[13]$"}, "ac"),  # a regular expression; a missing number never matches
        ({"plant": "1001", "search": "0001"}, ""),
    ],
)
def test_filters(report, filters, expected):
    assert sorted(ids(serving.shortage_filtered(report, **filters))) == list(expected)


def test_filter_options_are_sorted_and_filled(report):
    assert ids(serving.filter_options(report, "plant"), "plant") == ["1000", "1001"]


def test_overview(report):
    row = as_dicts(serving.overview_kpis(report))[0]
    assert (row["materials"], row["shortage_count"], float(row["shortage_pct"])) == (4, 2, 50.0)
    assert (row["overdue_total"], row["max_red_days"]) == (15, 20)
    empty = as_dicts(serving.overview_kpis(report.where("1 = 0")))[0]
    assert (empty["materials"], empty["shortage_pct"], empty["overdue_total"]) == (0, 0, 0)


def test_backlog_by_plant(report):
    got = {r["plant"]: r for r in as_dicts(serving.backlog_by_plant(report))}
    assert got["1000"]["overdue_backlog_qty"] == 10
    assert got["1000"]["materials_with_backlog"] == 1


def test_vendor_order_and_bands(vendors):
    assert ids(serving.vendors_ranked(vendors), "vendor_number") == ["4", "3", "1", "2"]
    assert ids(serving.vendors_bottom(vendors, 2), "vendor_number") == ["4", "3"]
    bands = {r["vendor_number"]: r["band"] for r in as_dicts(serving.vendor_band(vendors))}
    assert bands == {"1": "good", "3": "warn", "4": "bad"}


def test_vendor_kpis(vendors):
    row = as_dicts(serving.vendor_kpis(vendors))[0]
    assert (row["vendors"], row["worst_vendor"], row["late_qty_total"]) == (4, "Four", 7)
    assert float(row["avg_otd"]) == pytest.approx((0.85 + 0.6 + 0.599) / 3, abs=1e-6)


CONSUMPTION = (
    "marc_id string, material_number string, plant string, requirement_date date,"
    " daily_consumption decimal(28,4)"
)


def test_weeks_end_on_sunday_and_gaps_are_zero(frame):
    rows = [
        ("1000", date(2000, 1, 3), 1),  # Monday
        ("1000", date(2000, 1, 9), 2),  # Sunday of the same week
        ("1000", date(2000, 1, 24), 4),
        ("1001", date(2000, 2, 6), 8),
    ]
    consumption = frame(CONSUMPTION, [("m", "m", p, d, Decimal(q)) for p, d, q in rows])
    got = {
        (r["plant"], r["week_ending"]): int(r["total_consumption"])
        for r in as_dicts(serving.weekly_demand(consumption))
    }
    assert got == {
        ("1000", date(2000, 1, 9)): 3,
        ("1000", date(2000, 1, 16)): 0,
        ("1000", date(2000, 1, 23)): 0,
        ("1000", date(2000, 1, 30)): 4,
        ("1001", date(2000, 2, 6)): 8,
    }


def test_top_materials_and_kpis(frame, report):
    rows = [("a", 1), ("b", 5), ("a", 6), ("c", 5), ("d", 1)]
    consumption = frame(
        CONSUMPTION, [(m, m, "1000", date(2000, 1, 3), Decimal(q)) for m, q in rows]
    )
    assert ids(serving.top_demand_materials(consumption, 3)) == ["a", "b", "c"]
    row = as_dicts(serving.demand_kpis(consumption, report))[0]
    assert (row["total_demand"], row["total_backlog"], row["materials_with_backlog"]) == (18, 15, 2)


def test_red_zone_and_selection(frame, report):
    simulation = frame(
        "marc_id string, calendar_date date, simulated_inventory_qty decimal(20,2)",
        [(m, date(2000, 1, d), Decimal(q)) for m in "ac" for d, q in [(3, 1), (4, -1), (5, -2)]],
    )
    detail = report.selectExpr(
        "*", "1 AS available_stock", "2 AS safety_stock", "3 AS max_tt",
        "DATE '2000-01-06' AS end_of_tt_gr",
    )
    got = as_dicts(serving.red_zone(simulation, detail, "a"))
    assert sorted(r["simulated_inventory_qty"] for r in got) == [-2, -1]
    assert {r["window_start"] for r in got} == {date(2000, 1, 3)}
    assert {r["window_end"] for r in got} == {date(2000, 1, 6)}
    assert serving.red_zone(simulation, detail).count() == 4
    assert ids(serving.simulation_for_material(simulation, "a")) == ["a"] * 3
