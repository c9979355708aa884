import random
import re
from decimal import Decimal

from planning_cases import as_dicts, day

from runout.operators.purchasing import late_shipment, po_active, po_transit_quota
from runout.operators.quota import quota_header_active, quota_share, transit_quota

LINES = (
    "id int, marc_id string, vendor_number string, planned_availability_date date,"
    " open_quantity decimal(20,2), delivery_date date, transit_time_days int"
)
ASN = (
    "marc_id string, vendor_number string, planned_availability_date date,"
    " delivery_quantity decimal(10,2)"
)


def line(i, pad, qty, marc="M", vendor="V", due=0, transit=10):
    return (i, marc, vendor, pad, Decimal(qty), day(due), transit)


def cover(frame, params, lines, deliveries):
    rows = as_dicts(late_shipment(frame(LINES, lines), frame(ASN, deliveries), params))
    return {r["id"]: r for r in rows}


def test_delivery_on_the_same_day_counts(frame, params):
    got = cover(frame, params, [line(1, day(5), 10)], [("M", "V", day(5), Decimal(4))])
    assert got[1]["cumulative_asn_qty"] == 4 and got[1]["order_qty_due"] == 6
    got = cover(frame, params, [line(1, day(5), 10)], [("M", "V", day(6), Decimal(4))])
    assert got[1]["cumulative_asn_qty"] == 0


def test_one_delivery_covers_several_lines(frame, params):
    lines = [line(1, day(5), 10), line(2, day(6), 10)]
    got = cover(frame, params, lines, [("M", "V", day(5), Decimal(10))])
    assert [got[i]["order_qty_due"] for i in (1, 2)] == [0, 0]
    assert [got[i]["late_shipment_flag"] for i in (1, 2)] == [0, 0]


def test_null_keys_match_nothing(frame, params):
    lines = [line(1, day(5), 10, vendor=None), line(2, None, 10), line(3, day(5), 10, marc=None)]
    deliveries = [
        ("M", None, day(1), Decimal(1)),
        (None, "V", day(1), Decimal(1)),
        ("M", "V", None, Decimal(1)),
    ]
    got = cover(frame, params, lines, deliveries)
    assert [got[i]["cumulative_asn_qty"] for i in (1, 2, 3)] == [0, 0, 0]


def test_late_only_within_the_transit_time(frame, params):
    lines = [
        line(1, day(5), 10, due=-10, transit=10),
        line(2, day(5), 10, due=-11, transit=10),
        line(3, day(5), 10, due=0, transit=None),
        line(4, day(5), 10, due=-1, transit=None),
    ]
    got = cover(frame, params, lines, [])
    assert [got[i]["late_shipment_flag"] for i in (1, 2, 3, 4)] == [1, 0, 1, 0]


def test_hot_pair_agrees_with_brute_force(frame, params):
    """A third of lines and deliveries on one (material, vendor)."""
    rng = random.Random(7)

    def pick():
        return ("M0", "V0") if rng.random() < 0.34 else (f"M{rng.randrange(6)}", f"V{rng.randrange(4)}")

    lines = []
    for i in range(600):
        marc, vendor = pick()
        lines.append(line(i, day(rng.randrange(-30, 200)), rng.randrange(1, 50), marc, vendor))
    deliveries = []
    for _ in range(400):
        marc, vendor = pick()
        deliveries.append((marc, vendor, day(rng.randrange(0, 140)), Decimal(rng.randrange(1, 9))))
    got = cover(frame, params, lines, deliveries)
    assert len(got) == len(lines)
    for i, marc, vendor, pad, *_ in lines:
        want = sum(q for m, v, d, q in deliveries if (m, v) == (marc, vendor) and d <= pad)
        assert got[i]["cumulative_asn_qty"] == want


def test_deletion_flags(frame):
    ekko = frame(
        "po_number string, vendor_number string, purchasing_org string, po_type string,"
        " po_date date, deletion_flag string",
        [(p, "V", "1000", "LP", day(-9), f) for p, f in [("1", None), ("2", "L"), ("3", "Z")]],
    )
    ekpo = frame(
        "ekpo_id string, po_number string, po_item string, material_number string, plant string,"
        " order_quantity decimal(10,2), deletion_flag string",
        [
            (f"{p}-{f}", p, "10", "M", "1000", Decimal(1), f)
            for p in "123"
            for f in (None, "S", "X", "Z")
        ],
    )
    assert sorted(r.ekpo_id for r in po_active(ekko, ekpo).collect()) == [
        "1-None",
        "1-Z",
        "3-None",
        "3-Z",
    ]


def quotas(frame, params, headers, items):
    equk = frame(
        "material_number string, plant string, quota_arrangement_number string, valid_from date,"
        " valid_to date, created_date date, total_released_quantity decimal(10,2)",
        [("M", "1000", q, a, b, day(-500), Decimal(0)) for q, a, b in headers],
    )
    equp = frame(
        "quota_arrangement_number string, quota_item string, vendor_number string,"
        " procurement_type string, quota decimal(10,2), planned_delivery_days decimal(10,2)",
        [(q, str(i), v, "F", Decimal(n), Decimal(5)) for i, (q, v, n) in enumerate(items)],
    )
    lfa1 = frame("vendor_number string, vendor_name string, country string", [("V1", "One", "DE")])
    return quota_share(quota_header_active(equk, params), equp, lfa1)


def test_quota_shares(frame, params):
    headers = [
        ("A", day(-5), day(0)),  # ends on the anchor: active
        ("B", day(0), day(9)),
        ("C", day(-9), day(-1)),  # expired
        ("D", day(-9), day(9)),
    ]
    items = [("A", "V1", 30), ("A", "V2", 10), ("B", "V1", 0), ("B", "V2", 0), ("C", "V1", 1)]
    got = {
        (r["quota_arrangement_number"], r["vendor_number"]): r
        for r in as_dicts(quotas(frame, params, headers, items))
    }
    assert got.keys() == {("A", "V1"), ("A", "V2"), ("B", "V1"), ("B", "V2")}
    assert float(got["A", "V1"]["quote_percent"]) == 0.75
    assert got["B", "V1"]["quote_percent"] is None  # the total is 0
    assert got["A", "V1"]["vendor_name"] == "One" and got["A", "V2"]["vendor_name"] is None


def test_doubled_header_halves_the_share(frame, params):
    """Overlapping headers are kept, so the total counts each item once per header."""
    headers = [("A", day(-5), day(5)), ("A", day(-5), day(50))]
    got = as_dicts(quotas(frame, params, headers, [("A", "V1", 30), ("A", "V2", 10)]))
    assert sorted(float(r["quote_percent"]) for r in got) == [0.125, 0.125, 0.375, 0.375]


def test_headers_are_read_once_and_those_without_a_number_are_no_group(frame, params):
    headers = [("A", day(-5), day(5)), (None, day(-5), day(5)), (None, day(-5), day(9))]
    shares = quotas(frame, params, headers, [("A", "V1", 30), ("A", "V1", 30), (None, "V1", 5)])
    assert [float(r["quote_percent"]) for r in as_dicts(shares)] == [0.5, 0.5]
    plan = shares._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"LocalRelation|LogicalRDD", plan)) == 4  # headers, items twice, vendors


def test_largest_share_and_slowest_vendor(frame):
    po = frame(
        "ekpo_id string, marc_id string, material_number string, plant string,"
        " vendor_number string, purchasing_org string",
        [(str(i), "M-1000", "M", "1000", v, "1000") for i, v in enumerate(["V1", "V1", "V2", "V3"])],
    )
    lanes = frame(
        "vendor_number string, plant string, purchasing_org string, transit_time_days int",
        [("V1", "1000", "1000", 3), ("V2", "1000", "1000", 21)],
    )
    plants = frame("plant string, factory_calendar_key string", [("1000", "01")])
    shares = frame(
        "material_number string, plant string, vendor_number string, quote_percent decimal(38,18)",
        [("M", "1000", "V1", Decimal("0.2")), ("M", "1000", "V1", Decimal("0.6"))],
    )
    orders = po_transit_quota(po, lanes, plants, shares)
    assert orders.count() == 4  # two shares for V1 do not double its items
    keys = {(r["vendor_number"], r["factory_calendar_key"]) for r in as_dicts(orders)}
    assert keys == {("V1", "01"), ("V2", "01"), ("V3", None)}  # no lane, no calendar
    got = {r["vendor_number"]: r for r in as_dicts(transit_quota(orders))}
    assert {v: r["transit_time_days"] for v, r in got.items()} == {"V1": 3, "V2": 21, "V3": None}
    assert {r["max_tt"] for r in got.values()} == {21}
    assert float(got["V1"]["quote_percent"]) == 0.6
