import random
from decimal import Decimal

import pytest
from planning_cases import as_dicts, day

from runout.operators.demand import backlog, consumption, demand_union
from runout.operators.projection import inventory_simulation, shortage_report, stock_runs
from runout.params import Params

DEMAND = (
    "customer_order string, co_item string, requirement_type string, marc_id string,"
    " material_number string, plant string, requirement_date date, demand_qty decimal(18,4),"
    " demand_source string"
)


def demand_of(frame, rows):
    """rows: (marc_id, day offset or None, quantity[, type])."""
    return frame(
        DEMAND,
        [
            (
                str(i),
                "1",
                r[3] if len(r) > 3 else "M",
                r[0],
                r[0],
                "1000",
                None if r[1] is None else day(r[1]),
                Decimal(r[2]),
                "RESB",
            )
            for i, r in enumerate(rows)
        ],
    )


def runs_of(frame, params, demand=(), asn=(), stock=(("M", 100),), plants=("1000",)):
    stocks = frame(
        "marc_id string, material_number string, plant string, abc_indicator string,"
        " available_stock decimal(20,2), safety_stock decimal(10,2)",
        [(m, m, "1000", "A", Decimal(q), Decimal(5)) for m, q in stock],
    )
    announced = frame(
        "marc_id string, planned_availability_date date, delivery_quantity decimal(10,2),"
        " asn_status string",
        [(m, day(d), Decimal(q), "future" if d >= 0 else "overdue") for m, d, q in asn],
    )
    return stock_runs(
        stocks,
        demand_of(frame, demand),
        announced,
        frame("plant string", [(p,) for p in plants]),
        params,
    )


def simulate(frame, params, **inputs):
    rows = as_dicts(inventory_simulation(runs_of(frame, params, **inputs)))
    return {(r["marc_id"], r["calendar_date"]): r for r in rows}


def report(frame, params, max_tt=None, **inputs):
    tt = [] if max_tt is None else [("M", max_tt)]
    slowest = frame("marc_id string, max_tt int", tt)
    return as_dicts(shortage_report(runs_of(frame, params, **inputs), slowest, params))[0]


def test_horizon_has_121_days(frame, params):
    got = simulate(frame, params)
    assert sorted(d for _, d in got) == [day(i) for i in range(121)]
    assert {r["simulated_inventory_qty"] for r in got.values()} == {100}


def test_running_balance(frame, params):
    got = simulate(
        frame,
        params,
        demand=[("M", 0, 10), ("M", 0, 5), ("M", 3, 20), ("M", 120, 1), ("M", 121, 50)],
        asn=[("M", 2, 7), ("M", 3, 1), ("M", -1, 99), ("M", 130, 99), (None, 1, 99)],
    )
    qty = {i: got["M", day(i)]["simulated_inventory_qty"] for i in (0, 1, 2, 3, 4, 119, 120)}
    assert qty == {0: 85, 1: 85, 2: 92, 3: 73, 4: 73, 119: 73, 120: 72}
    assert got["M", day(0)]["daily_consumption"] == 15
    assert got["M", day(1)]["daily_consumption"] == 0
    assert got["M", day(3)]["daily_asn_qty"] == 1
    assert len(got) == 121


def test_overdue_demand_reduces_the_opening(frame, params):
    got = simulate(frame, params, demand=[("M", -3, 5)])
    assert got["M", day(0)]["backlog_qty"] == 5
    assert got["M", day(0)]["simulated_inventory_qty"] == 95
    got = simulate(frame, params, demand=[("M", -3, 5), ("M", 9, 1)])
    assert got["M", day(0)]["simulated_inventory_qty"] == 95


def test_overdue_is_lost_with_demand_past_the_horizon_only(frame, params):
    got = simulate(frame, params, demand=[("M", -3, 5), ("M", 125, 1)])
    assert got["M", day(0)]["backlog_qty"] == 0
    assert got["M", day(120)]["simulated_inventory_qty"] == 100


def test_unknown_materials_and_plants_drop_out(frame, params):
    got = simulate(frame, params, demand=[("X", 0, 5), (None, 0, 5), ("M", None, 5)])
    assert {m for m, _ in got} == {"M"}
    assert got["M", day(0)]["simulated_inventory_qty"] == 100
    assert simulate(frame, params, plants=("1001",)) == {}


def test_grid_ends_with_the_calendar(frame, params):
    short = Params(anchor=params.anchor, horizon=120, calendar_ahead=10)
    got = simulate(frame, short, demand=[("M", 8, 1), ("M", 50, 7)])
    assert len(got) == 11
    assert got["M", day(10)]["simulated_inventory_qty"] == 99


@pytest.mark.parametrize("first_red, status", [(3, "Shortage"), (4, "No Shortage")])
def test_status_depends_on_the_transit_window(frame, params, first_red, status):
    got = report(frame, params, max_tt=3, demand=[("M", first_red, 101)])
    assert got["status"] == status
    assert got["end_of_tt_gr"] == day(3)
    assert got["red_days"] == 121 - first_red
    assert got["red_days_in_tt"] == (1 if first_red == 3 else 0)
    assert got["min_qty_in_tt_gr"] == (-1 if first_red == 3 else 100)


def test_no_lane_means_the_anchor_only(frame, params):
    got = report(frame, params, demand=[("M", 0, 101), ("M", 1, 9)])
    assert (got["max_tt"], got["end_of_tt_gr"]) == (0, day(0))
    assert (got["red_days_in_tt"], got["min_qty_in_tt_gr"]) == (1, -1)


def test_window_past_the_horizon_counts_to_the_horizon(frame, params):
    got = report(frame, params, max_tt=500, demand=[("M", 100, 101)])
    assert got["red_days"] == got["red_days_in_tt"] == 21


def test_recovery_by_a_delivery(frame, params):
    got = report(frame, params, max_tt=30, demand=[("M", 5, 130)], asn=[("M", 9, 60)])
    assert (got["red_days"], got["red_days_in_tt"], got["min_qty_in_tt_gr"]) == (4, 4, -30)


def known(frame):
    rows = [(m, m, "1000") for m in "MN"]
    return frame("marc_id string, material_number string, plant string", rows)


def test_empty_row_for_overdue_only(frame, params):
    demand = demand_of(frame, [("M", -3, 5), ("N", -3, 5), ("N", 125, 1), ("X", -3, 5)])
    rows = as_dicts(backlog(demand, known(frame), params))
    assert len(rows) == 1  # N has demand past the horizon, so it gets no row at all
    row = rows[0]
    assert (row["marc_id"], row["backlog_per_pn"], row["backlog_per_pn_contype"]) == ("M", 5, 0)
    assert row["requirement_date"] is None and row["material_number"] is None


def test_overdue_figures_of_future_lines(frame, params):
    demand = demand_of(
        frame,
        [("M", -3, 5, "A"), ("M", -2, 7, None), ("M", 1, 1, "A"), ("M", 2, 1, None), ("X", 1, 9)],
    )
    rows = {r["requirement_type"]: r for r in as_dicts(backlog(demand, known(frame), params))}
    assert len(rows) == 2  # nothing of the unknown material
    assert rows["A"]["backlog_per_pn"] == rows[None]["backlog_per_pn"] == 12
    assert rows["A"]["backlog_per_pn_contype"] == 5
    assert rows[None]["backlog_per_pn_contype"] == 0  # a missing type matches no type


def test_reservations_need_an_open_quantity_and_requirements_do_not(frame):
    resb = frame(
        "reservation_number string, reservation_item string, reservation_type string,"
        " material_number string, plant string, requirement_date date,"
        " required_quantity decimal(10,2), withdrawn_quantity decimal(10,2)",
        [("1", "1", "M", "M", "1000", day(1), Decimal(5), Decimal(w)) for w in (5, 6, 2)]
        + [("1", "1", "M", "M", "1000", day(1), Decimal(5), None)],
    )
    vbbe = frame(
        "sales_order_number string, sales_order_item string, requirement_type string,"
        " material_number string, plant string, requirement_date date,"
        " open_requirement_qty decimal(18,4)",
        [("2", "1", "KE", "M", "1000", day(1), Decimal(q)) for q in (0, -1, 4)],
    )
    got = sorted((r.demand_source, int(r.demand_qty)) for r in demand_union(resb, vbbe).collect())
    assert got == [("RESB", 3), ("VBBE", -1), ("VBBE", 0), ("VBBE", 4)]


def test_consumption_is_daily_and_known_materials_only(frame, params):
    materials = known(frame)
    demand = demand_of(
        frame, [("M", 0, 1), ("M", 0, 2), ("M", 120, 4), ("M", 121, 8), ("M", -1, 8), ("X", 0, 8)]
    )
    got = {
        r["requirement_date"]: int(r["daily_consumption"])
        for r in as_dicts(consumption(demand, materials, params))
    }
    assert got == {day(0): 3, day(120): 4}


def test_hot_material_agrees_with_brute_force(frame, params):
    """A third of the demand and of the deliveries on one material, none of it dropped."""
    rng = random.Random(11)

    def pick():
        return "M0" if rng.random() < 0.34 else f"M{rng.randrange(8)}"

    demand = [(pick(), rng.randrange(-20, 140), rng.randrange(1, 9)) for _ in range(700)]
    asn = [(pick(), rng.randrange(-20, 140), rng.randrange(1, 9)) for _ in range(300)]
    stock = [(f"M{i}", 50 * i) for i in range(10)]  # M8 and M9 have neither
    got = simulate(frame, params, demand=demand, asn=asn, stock=stock)
    assert len(got) == 121 * len(stock)
    for material, opening in stock:
        mine = [(d, q) for m, d, q in demand if m == material]
        overdue = sum(q for d, q in mine if d < 0)
        if not any(0 <= d <= 120 for d, _ in mine) and any(d > 120 for d, _ in mine):
            overdue = 0
        for i in (0, 1, 17, 60, 119, 120):
            used = sum(q for d, q in mine if 0 <= d <= i)
            come = sum(q for m, d, q in asn if m == material and 0 <= d <= i)
            want = opening - overdue - used + come
            assert got[material, day(i)]["simulated_inventory_qty"] == want
