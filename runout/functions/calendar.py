"""Plant calendars and working-day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runout.functions.columns import col, whole
from runout.params import Params


def factory_calendar(plants: DataFrame, p: Params) -> DataFrame:
    """One row per (plant, day). Monday to Friday are working days for every plant.

    A window partition holds one plant's calendar, ``calendar_back + calendar_ahead + 1`` rows.
    """
    day = F.col("calendar_date")
    weekday = F.weekday(day)
    running = (
        Window.partitionBy("plant")
        .orderBy("calendar_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        plants.select(
            "plant",
            "factory_calendar_key",
            F.explode(F.sequence(F.lit(p.calendar_start), F.lit(p.calendar_end))).alias(
                "calendar_date"
            ),
        )
        .withColumn("is_workingday", (weekday < 5).cast("int"))
        .withColumn(
            "jump_to_wd_date", F.when(weekday >= 5, F.date_add(day, 7 - weekday)).otherwise(day)
        )
        .withColumn("technical_day_number", F.sum("is_workingday").over(running))
    )


def working_calendar(calendar: DataFrame) -> DataFrame:
    """The working days of a calendar, numbered from 1 within each plant."""
    by_day = Window.partitionBy("plant").orderBy("calendar_date")
    return calendar.where("is_workingday = 1").select(
        "plant",
        "factory_calendar_key",
        "calendar_date",
        F.row_number().over(by_day).cast("bigint").alias("working_day_index"),
    )


def calendar_index(calendar: DataFrame) -> DataFrame:
    """A calendar folded to one row per plant, to be joined on the plant alone.

    ``day_flags`` and ``day_numbers`` are indexed by days since ``first_day``; ``working_days``
    lists the working days in order. Every array is bounded by the length of the calendar.
    """
    days = F.sort_array(
        F.collect_list(F.struct("calendar_date", "is_workingday", "technical_day_number"))
    )
    return (
        calendar.groupBy("plant")
        .agg(F.min("calendar_date").alias("first_day"), days.alias("days"))
        .select(
            F.col("plant").alias("calendar_plant"),
            "first_day",
            F.col("days.is_workingday").alias("day_flags"),
            F.col("days.technical_day_number").alias("day_numbers"),
            F.filter("days", lambda d: d["is_workingday"] == 1)["calendar_date"].alias(
                "working_days"
            ),
        )
    )


def at_day(array: str, day: str | Column) -> Column:
    """Look a day up in an array of ``calendar_index``; NULL outside the calendar."""
    return F.get(F.col(array), F.datediff(col(day), F.col("first_day")))


def with_calendar(df: DataFrame, index: DataFrame, plant: str = "plant") -> DataFrame:
    """Attach the folded calendar of each row's plant (NULL arrays when it has none)."""
    return df.join(index, F.col(plant) == F.col("calendar_plant"), "left")


def add_working_days(
    df: DataFrame, index: DataFrame, start: str, days: str, out: str, plant: str = "plant"
) -> DataFrame:
    """Add ``days`` working days to ``start`` on the plant's calendar, into column ``out``.

    A start on a free day counts from the next working day. NULL days mean 0. The result is NULL
    when the plant has no calendar or when the start or the target lies outside it.
    """
    steps = F.coalesce(whole(days), F.lit(0))
    # 0-based position of the start among the working days: the day number counts the start
    # itself when it is a working day and not when it is free, hence the minus on the flag
    position = at_day("day_numbers", start) - at_day("day_flags", start)
    target = F.get(F.col("working_days"), (position + steps).cast("int"))
    return with_calendar(df, index, plant).select(*df.columns, target.alias(out))
