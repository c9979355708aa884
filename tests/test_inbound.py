from decimal import Decimal

import pytest
from planning_cases import as_dicts, day

from runout.functions.calendar import calendar_index, factory_calendar
from runout.operators.inbound import (
    announced_deliveries,
    asn_status,
    delivery_lines,
    inbound_deliveries,
)
from runout.operators.vendors import vendor_performance

# delivery, created offset, issued offset or None, status, material, quantity, order
CASES = [
    ("D1", -5, -7, "C", "M", 1, "P1"),  # received, issued before it was created
    ("D2", 3, None, "A", "M", 2, "P1"),  # future
    ("D3", -9, -8, None, "M", 4, "P2"),  # no status: still open, overdue
    ("D4", -800, None, "B", "M", 8, "P2"),  # outside the calendar: pending
    ("D5", 3, None, "A", "X", 16, "P9"),  # unknown material and order
    ("D6", -9, None, "A", "X", 32, "P1"),
]


@pytest.fixture(scope="module")
def tables(frame, params):
    likp = frame(
        "delivery_number string, delivery_type string, created_date date,"
        " planned_delivery_date date, actual_goods_issue_date date",
        [(d, "EL", day(c), day(-7), None if i is None else day(i)) for d, c, i, *_ in CASES],
    )
    lips = frame(
        "delivery_number string, delivery_item string, material_number string,"
        " material_group string, plant string, storage_location string,"
        " reference_document string, reference_item string, movement_type string,"
        " goods_receipt_date date, delivery_quantity decimal(10,2), net_value decimal(10,2),"
        " unit_of_measure string",
        [
            (d, "1", m, None, "1000", None, p, "1", "101", None, Decimal(q), None, "EA")
            for d, _, _, _, m, q, p in CASES
        ],
    )
    vbup = frame(
        "document_number string, document_item string, goods_movement_status string",
        [(d, "1", s) for d, _, _, s, *_ in CASES if s],
    )
    marc = frame(
        "marc_id string, material_number string, plant string, gr_processing_days decimal(10,2)",
        [("M-1000", "M", "1000", Decimal(0))],
    )
    ekko = frame("po_number string, vendor_number string", [("P1", "V1"), ("P2", "V2")])
    lfa1 = frame(
        "vendor_number string, vendor_name string, country string",
        [("V1", "One", "DE"), ("V2", "Two", "CN"), ("V3", "Three", "JP")],
    )
    plants = frame("plant string, factory_calendar_key string", [("1000", "01")])
    index = calendar_index(factory_calendar(plants, params))
    return {"likp": likp, "lips": lips, "vbup": vbup, "marc": marc, "ekko": ekko, "lfa1": lfa1,
            "index": index}


def test_status_and_totals(tables, params):
    inbound = inbound_deliveries(*[tables[t] for t in ("likp", "lips", "vbup", "marc")])
    assert inbound.count() == len(CASES)
    announced = announced_deliveries(inbound, tables["index"], params)
    got = {
        r["delivery_number"]: r
        for r in as_dicts(asn_status(announced, tables["ekko"], tables["lfa1"]))
    }
    assert {d: r["asn_status"] for d, r in got.items()} == {
        "D2": "future",
        "D3": "overdue",
        "D4": "pending",
        "D5": "future",
        "D6": "overdue",
    }
    # per material over all vendors; unknown materials share one total
    assert {d: r["asn_total_due_qty"] for d, r in got.items()} == {
        "D2": 12, "D3": 12, "D4": 12, "D5": 32, "D6": 32,
    }
    assert got["D4"]["planned_availability_date"] is None
    assert got["D5"]["vendor_number"] is None and got["D5"]["marc_id"] is None
    assert got["D3"]["vendor_name"] == "Two"


def test_receipt_day_is_the_earlier_one(tables):
    lines = delivery_lines(tables["likp"], tables["lips"], tables["vbup"])
    got = {r["delivery_number"]: r["gr_date"] for r in as_dicts(lines)}
    assert got["D1"] == day(-7) and got["D2"] == day(3) and got["D3"] == day(-9)


def test_vendor_scorecard(frame, tables):
    lines = delivery_lines(tables["likp"], tables["lips"], tables["vbup"])
    late = frame(
        "vendor_number string, late_shipment_flag int, order_qty_due decimal(20,2)",
        [("V1", 1, Decimal(5)), ("V1", 1, Decimal(6)), ("V1", 0, Decimal(-7))],
    )
    lanes = frame(
        "vendor_number string, transit_time_days int", [("V1", 3), ("V1", 4), ("V1", 3), ("V1", 3)]
    )
    got = {
        r["vendor_number"]: r
        for r in as_dicts(vendor_performance(tables["lfa1"], lines, tables["ekko"], late, lanes))
    }
    assert set(got) == {"V1", "V2", "V3"}
    one = got["V1"]
    assert (one["completed_delivery_lines"], one["on_time_lines"], one["otd_rate"]) == (1, 1, 1)
    assert (one["late_shipment_lines"], one["late_qty_due"]) == (2, 11)
    assert float(one["avg_transit_time_days"]) == 3.3  # 3.25, the half away from zero
    two = got["V2"]
    assert two["otd_rate"] is None and two["completed_delivery_lines"] == 0
    assert two["late_qty_due"] == 0 and two["avg_transit_time_days"] is None
