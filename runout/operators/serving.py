"""Queries a planner's dashboard runs over the marts.

Lists keep the marts' NULL order explicit; ties are broken by id, so that a limit is repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTAGE = "Shortage"
# on-time rate below which a vendor is bad, then merely to be watched
BAD_BELOW = 0.6
WARN_BELOW = 0.85


def shortage_ranked(report: DataFrame) -> DataFrame:
    return report.orderBy(
        F.desc_nulls_first("red_days_in_tt"), F.desc_nulls_first("red_days"), "marc_id"
    )


def simulation_for_material(simulation: DataFrame, marc_id: str) -> DataFrame:
    """The projection of one material."""
    return simulation.where(F.col("marc_id") == marc_id).orderBy("calendar_date")


def vendors_ranked(vendors: DataFrame) -> DataFrame:
    return vendors.orderBy(F.asc_nulls_last("otd_rate"), "vendor_number")


def consumption_trend(consumption: DataFrame) -> DataFrame:
    return (
        consumption.groupBy("requirement_date", "plant")
        .agg(F.sum("daily_consumption").alias("total_consumption"))
        .orderBy("requirement_date", "plant")
    )


def top_demand_materials(consumption: DataFrame, limit: int = 10) -> DataFrame:
    """The materials with the largest demand over the horizon."""
    return (
        consumption.groupBy("marc_id", "material_number", "plant")
        .agg(F.sum("daily_consumption").alias("total_demand"))
        .orderBy(F.desc_nulls_first("total_demand"), "marc_id")
        .limit(limit)
    )


def backlog_by_plant(report: DataFrame) -> DataFrame:
    return (
        report.groupBy("plant")
        .agg(
            F.sum("overdue_backlog_qty").alias("overdue_backlog_qty"),
            F.count_if(F.col("overdue_backlog_qty") > 0).alias("materials_with_backlog"),
        )
        .orderBy(F.asc_nulls_last("plant"))
    )


def shortage_filtered(
    report: DataFrame,
    plant: str | None = None,
    abc_class: str | None = None,
    status: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """All given filters together; ``search`` is a regular expression on the material number."""
    for column, wanted in (("plant", plant), ("abc_class", abc_class), ("status", status)):
        if wanted is not None:
            report = report.where(F.col(column) == wanted)
    if search:
        report = report.where(F.coalesce(F.col("material_number").rlike(search), F.lit(False)))
    return report


def filter_options(report: DataFrame, column: str) -> DataFrame:
    return report.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def overview_kpis(report: DataFrame) -> DataFrame:
    """Materials, how many (and which share) are short, overdue quantity, most red days."""
    n = F.count("*")
    short = F.count_if(F.col("status") == SHORTAGE)
    percent = F.round(short.cast("decimal(18,0)") / F.nullif(n, F.lit(0)) * 100, 1)
    return report.agg(
        n.alias("materials"),
        short.alias("shortage_count"),
        F.coalesce(percent, F.lit(0)).alias("shortage_pct"),
        F.coalesce(F.sum("overdue_backlog_qty"), F.lit(0)).alias("overdue_total"),
        F.max("red_days").alias("max_red_days"),
    )


def red_zone(simulation: DataFrame, report: DataFrame, marc_id: str | None = None) -> DataFrame:
    """Days below zero with the material's summary and its transit window.

    The window runs from the material's first projected day, which is the anchor, to the end of its
    slowest transit. For one material the filter reaches both scans; without one, every material's
    red days are listed.
    """
    if marc_id is not None:
        simulation = simulation.where(F.col("marc_id") == marc_id)
        report = report.where(F.col("marc_id") == marc_id)
    summary = report.select(
        "marc_id",
        F.date_sub("end_of_tt_gr", F.col("max_tt")).alias("window_start"),
        F.col("end_of_tt_gr").alias("window_end"),
        "available_stock",
        "safety_stock",
        "overdue_backlog_qty",
        "max_tt",
        "status",
        "red_days_in_tt",
    )
    return (
        simulation.where(F.col("simulated_inventory_qty") < 0)
        .select("marc_id", "calendar_date", "simulated_inventory_qty")
        .join(summary, "marc_id")
    )


def vendor_kpis(vendors: DataFrame) -> DataFrame:
    """Vendor count, mean on-time rate over rated vendors, the worst one, total late quantity."""
    rate = F.col("otd_rate")
    # the worst rated vendor, the lowest number among equals
    worst = F.min(
        F.when(rate.isNotNull(), F.struct("otd_rate", "vendor_number", "vendor_name"))
    )
    return vendors.agg(
        F.count("*").alias("vendors"),
        F.avg("otd_rate").alias("avg_otd"),
        worst.alias("worst"),
        F.coalesce(F.sum("late_qty_due"), F.lit(0)).alias("late_qty_total"),
    ).select(
        "vendors",
        "avg_otd",
        F.col("worst.otd_rate").alias("worst_otd"),
        F.col("worst.vendor_name").alias("worst_vendor"),
        "late_qty_total",
    )


def vendors_bottom(vendors: DataFrame, limit: int = 10) -> DataFrame:
    """The rated vendors with the lowest on-time rate."""
    return (
        vendors.where("otd_rate IS NOT NULL").orderBy("otd_rate", "vendor_number").limit(limit)
    )


def otd_band(rate: Column) -> Column:
    return F.when(rate < BAD_BELOW, "bad").when(rate < WARN_BELOW, "warn").otherwise("good")


def vendor_band(vendors: DataFrame) -> DataFrame:
    """Rated vendors with the band of their on-time rate."""
    return vendors.where("otd_rate IS NOT NULL").select(
        "vendor_number", "vendor_name", "otd_rate", otd_band(F.col("otd_rate")).alias("band")
    )


def demand_kpis(consumption: DataFrame, report: DataFrame) -> DataFrame:
    demand = consumption.agg(
        F.coalesce(F.sum("daily_consumption"), F.lit(0)).alias("total_demand")
    )
    overdue = report.agg(
        F.coalesce(F.sum("overdue_backlog_qty"), F.lit(0)).alias("total_backlog"),
        F.count_if(F.col("overdue_backlog_qty") > 0).alias("materials_with_backlog"),
    )
    # one row each, laid over one another
    both = demand.unionByName(overdue, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def weekly_demand(consumption: DataFrame) -> DataFrame:
    """Demand per plant and week, labelled by the week's Sunday; empty weeks in between are 0."""
    day = F.col("requirement_date")
    weekly = (
        consumption.withColumn("week_ending", F.date_add(day, 6 - F.weekday(day)))
        .groupBy("plant", "week_ending")
        .agg(F.sum("daily_consumption").alias("total_consumption"))
    )
    span = weekly.groupBy("plant").agg(
        F.min("week_ending").alias("first"), F.max("week_ending").alias("last")
    )
    weeks = span.select(
        "plant",
        F.explode(F.sequence("first", "last", F.expr("interval 7 days"))).alias("week_ending"),
    )
    return weeks.join(weekly, ["plant", "week_ending"], "left").select(
        "plant",
        "week_ending",
        F.coalesce("total_consumption", F.lit(0)).alias("total_consumption"),
    )
