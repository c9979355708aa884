from datetime import date

import pytest
from planning_cases import ANCHOR, day
from pyspark.sql import functions as F

from runout.functions.calendar import (
    add_working_days,
    calendar_index,
    factory_calendar,
    working_calendar,
)


@pytest.fixture(scope="module")
def calendar(frame, params):
    plants = frame("plant string, factory_calendar_key string", [("1000", "01"), ("1001", "02")])
    return factory_calendar(plants, params).cache()


def test_bounds_and_flags(calendar):
    assert calendar.count() == 2 * 951
    by_day = {r.calendar_date: r for r in calendar.where("plant = '1000'").collect()}
    assert min(by_day) == day(-750) and max(by_day) == day(200)
    saturday, sunday, monday = (by_day[date(2000, 1, d)] for d in (8, 9, 10))
    assert (saturday.is_workingday, sunday.is_workingday, monday.is_workingday) == (0, 0, 1)
    assert saturday.jump_to_wd_date == sunday.jump_to_wd_date == monday.jump_to_wd_date
    assert saturday.technical_day_number == sunday.technical_day_number
    assert monday.technical_day_number == sunday.technical_day_number + 1


def test_day_number_is_the_working_day_index(calendar):
    both = calendar.where("is_workingday = 1").join(
        working_calendar(calendar), ["plant", "calendar_date"]
    )
    assert both.count() == working_calendar(calendar).count()
    assert both.where("technical_day_number <> working_day_index").count() == 0


@pytest.mark.parametrize(
    "start, days, expected",
    [
        (date(2000, 1, 6), 2, date(2000, 1, 10)),  # Thursday + 2
        (date(2000, 1, 8), 0, date(2000, 1, 10)),  # Saturday
        (date(2000, 1, 9), 0, date(2000, 1, 10)),  # Sunday
        (date(2000, 1, 8), 1, date(2000, 1, 11)),
        (date(2000, 1, 6), None, date(2000, 1, 6)),  # no days given
        (date(2000, 1, 6), 2.5, date(2000, 1, 11)),  # rounded to 3
        (day(-800), 1, None),  # start before the calendar
        (day(199), 5, None),  # target behind it
        (None, 1, None),
    ],
)
def test_add_working_days(frame, calendar, start, days, expected):
    days = None if days is None else float(days)
    df = frame("plant string, start date, n double", [("1000", start, days)])
    row = add_working_days(df, calendar_index(calendar), "start", "n", "out").collect()[0]
    assert row.out == expected


def test_unknown_plant_has_no_working_days(frame, calendar):
    df = frame("plant string, start date, n int", [("9999", ANCHOR, 0), (None, ANCHOR, 0)])
    out = add_working_days(df, calendar_index(calendar), "start", "n", "out")
    assert [r.out for r in out.collect()] == [None, None]


def test_agrees_with_a_search_of_the_day_list(frame, calendar):
    """Every start day of the calendar with 0..6 days against a plain count of weekdays."""
    days = calendar.where("plant = '1001'").select("plant", F.col("calendar_date").alias("start"))
    df = days.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(6))))
    out = add_working_days(df, calendar_index(calendar), "start", "n", "out").collect()
    working = sorted(
        r.calendar_date for r in calendar.where("plant = '1001' AND is_workingday = 1").collect()
    )
    for r in out:
        later = [d for d in working if d >= r.start]
        assert r.out == (later[r.n] if r.n < len(later) else None)
