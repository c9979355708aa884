from decimal import Decimal

import pytest
from planning_cases import as_dicts, day

from runout.functions.calendar import calendar_index, factory_calendar
from runout.operators.supply import supply, supply_context, supply_gap_fill

PARTY = "marc_id string, material_number string, plant string, vendor_number string,"
PARTY += " vendor_name string, country string"
ROW = f"supply_type string, {PARTY}, planned_availability_date date"


@pytest.fixture(scope="module")
def index(frame, params):
    plants = frame("plant string, factory_calendar_key string", [("1000", "01")])
    return calendar_index(factory_calendar(plants, params)).cache()


def supplied(kind, offset, vendor="V", marc="M-1000", plant="1000"):
    when = None if offset is None else day(offset)
    return (kind, marc, "M", plant, vendor, "Name", "DE", when)


def filled(frame, params, index, rows):
    got = as_dicts(supply_gap_fill(frame(ROW, rows), index, params))
    assert {r["supply_type"] for r in got} <= {"Order Qty"}
    return {(r["vendor_number"], r["planned_availability_date"]) for r in got}


def test_fills_every_other_day_of_the_horizon(frame, params, index):
    rows = [supplied("Order Qty", o) for o in (5, 5, -4, 121)]
    assert filled(frame, params, index, rows) == {("V", day(i)) for i in range(121) if i != 5}


def test_a_delivery_blocks_the_fill(frame, params, index):
    rows = [supplied("Order Qty", 5), supplied("ASN", 7), supplied("ASN", 9, "W")]
    got = filled(frame, params, index, rows)
    # W has announced deliveries only, so it is no ordered pair
    assert got == {("V", day(i)) for i in range(121) if i not in (5, 7)}


def test_unknown_vendor_is_always_filled(frame, params, index):
    got = filled(frame, params, index, [supplied("Order Qty", 5, vendor=None)])
    assert got == {(None, day(i)) for i in range(121)}


def test_every_party_of_a_pair_is_filled_around_all_its_days(frame, params, index):
    rows = [supplied("Order Qty", 5), supplied("Order Qty", 5), supplied("ASN", 6)]
    rows += [("Order Qty", "M-1000", "M", "1000", "V", None, "FR", day(7))]
    rows += [("Order Qty", None, None, "1000", "V", "Name", "DE", day(8))]
    got = as_dicts(supply_gap_fill(frame(ROW, rows), index, params))
    days = {}
    for r in got:
        days.setdefault((r["marc_id"], r["vendor_name"], r["country"]), []).append(
            r["planned_availability_date"]
        )
    rest = [day(i) for i in range(121) if i not in (5, 6, 7)]
    assert {k: sorted(v) for k, v in days.items()} == {
        ("M-1000", "Name", "DE"): rest,
        ("M-1000", None, "FR"): rest,
        (None, "Name", "DE"): [day(i) for i in range(121)],
    }


def test_plant_without_calendar_is_not_filled(frame, params, index):
    assert filled(frame, params, index, [supplied("Order Qty", 5, plant="9999")]) == set()


def test_fill_carries_the_calendar_and_no_context(frame, params, index):
    got = as_dicts(supply_gap_fill(frame(ROW, [supplied("Order Qty", 5)]), index, params))
    first = min(got, key=lambda r: r["planned_availability_date"])
    assert first["is_workingday"] == 1 and first["technical_day_number"] > 500
    assert (first["order_qty"], first["order_qty_due"]) == (0, 0)
    assert first["available_stock"] is None and first["max_tt"] is None


def test_only_future_deliveries_are_supply(frame):
    lines = frame(
        f"{PARTY}, planned_availability_date date, open_quantity decimal(20,2),"
        " order_qty_due decimal(20,2), cumulative_asn_qty decimal(20,2)",
        [("M", "M", "1000", "V", "N", "DE", day(1), Decimal(9), Decimal(4), Decimal(5))],
    )
    deliveries = frame(
        f"{PARTY}, planned_availability_date date, delivery_quantity decimal(10,2),"
        " asn_total_due_qty decimal(20,2), asn_status string",
        [
            ("M", "M", "1000", "V", "N", "DE", day(1), Decimal(q), Decimal(8), s)
            for q, s in [(1, "future"), (2, "overdue"), (3, "pending")]
        ],
    )
    got = {r["supply_type"]: r for r in as_dicts(supply(lines, deliveries))}
    assert len(got) == 2
    assert (got["Order Qty"]["order_qty"], got["Order Qty"]["fulfill_qty"]) == (9, 5)
    assert (got["ASN"]["order_qty"], got["ASN"]["order_qty_due"]) == (1, 8)
    assert got["ASN"]["fulfill_qty"] is None


def test_context_outside_the_calendar_is_null(frame, params, index):
    supplies = frame(
        f"{ROW}, order_qty decimal(18,4), order_qty_due decimal(18,4), fulfill_qty decimal(18,4)",
        [(*supplied("Order Qty", o), Decimal(1), None, None) for o in (0, 201, None)],
    )
    stock = frame(
        "marc_id string, available_stock decimal(20,2), safety_stock decimal(10,2),"
        " abc_indicator string, gr_processing_days decimal(10,2)",
        [("M-1000", Decimal(3), Decimal(1), "A", Decimal(2))],
    )
    transit = frame(
        "marc_id string, vendor_number string, transit_time_days int,"
        " quote_percent decimal(38,18), max_tt int",
        [("M-1000", "V", 4, Decimal("0.5"), 9)],
    )
    got = as_dicts(supply_context(supplies, stock, transit, index))
    assert len(got) == 2  # the undated row is out
    by_day = {r["planned_availability_date"]: r for r in got}
    assert by_day[day(0)]["is_workingday"] == 1
    assert by_day[day(201)]["is_workingday"] is None
    assert by_day[day(201)]["max_tt"] == 9 and by_day[day(201)]["available_stock"] == 3
