"""Day-by-day inventory projection and the shortage report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runout.functions.columns import whole, zero_if_null
from runout.params import Params

ATTRIBUTES = ["material_number", "plant", "abc_indicator", "available_stock", "safety_stock"]


def stock_runs(
    stock: DataFrame, demand: DataFrame, announced: DataFrame, plants: DataFrame, p: Params
) -> DataFrame:
    """The projection as runs of days with an unchanged quantity, one row per run.

    The quantity of a material changes only on days with demand or a delivery, so the running sums
    need those days alone (at most the horizon's length per material); ``until`` is the last day
    of the run. Demand lines and deliveries are reduced by one aggregation per (material, day) with
    map-side combine, so neither a hot material nor a hot day is shuffled row by row. The second
    exchange moves these reduced rows and the stock rows to their material for the window.

    ``demand`` may hold unknown materials: they have no stock row and are dropped. Opening stock
    is reduced by the overdue demand when the material has demand inside the horizon, or none from
    the anchor on; with demand only past the horizon the overdue quantity is left out.
    """
    end = F.lit(p.grid_end)
    due = F.col("requirement_date")
    qty = F.col("demand_qty")
    in_horizon = due.between(p.today, F.lit(p.horizon_end))

    wanted = demand.where(due.isNotNull()).select(
        "marc_id",
        F.when(in_horizon, F.least(due, end)).otherwise(p.today).alias("day"),
        F.when(in_horizon & (due <= end), qty).alias("consumption"),
        F.when(due < p.today, qty).alias("overdue"),
        in_horizon.alias("planned"),
        (due > F.lit(p.horizon_end)).alias("later"),
    )
    arriving = announced.where(
        (F.col("asn_status") == "future")
        & F.col("marc_id").isNotNull()
        & (F.col("planned_availability_date") <= end)
    ).select(
        "marc_id",
        F.col("planned_availability_date").alias("day"),
        F.col("delivery_quantity").alias("arrival"),
    )
    daily = (
        wanted.unionByName(arriving, allowMissingColumns=True)
        .groupBy("marc_id", "day")
        .agg(
            zero_if_null(F.sum("consumption")).alias("consumption"),
            zero_if_null(F.sum("arrival")).alias("arrival"),
            zero_if_null(F.sum("overdue")).alias("overdue"),
            F.max("planned").alias("planned"),
            F.max("later").alias("later"),
        )
        .withColumn("is_stock", F.lit(False))
    )
    opening = stock.join(plants.select("plant"), "plant", "left_semi").select(
        "marc_id",
        p.today.alias("day"),
        *ATTRIBUTES,
        F.lit(True).alias("is_stock"),
        *[F.lit(0).alias(c) for c in ("consumption", "arrival", "overdue")],
    )

    material = Window.partitionBy("marc_id")
    # a material's stock row comes first, before any change on the same day
    in_order = material.orderBy("day", F.desc("is_stock"))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overdue = F.sum("overdue").over(material)
    planned = F.max("planned").over(material)
    later = F.max("later").over(material)
    counts = F.coalesce(planned, F.lit(False)) | (
        (overdue > 0) & ~F.coalesce(later, F.lit(False))
    )
    runs = opening.unionByName(daily, allowMissingColumns=True).select(
        "marc_id",
        "day",
        *[F.first(a).over(so_far).alias(a) for a in ATTRIBUTES],
        F.first("is_stock").over(so_far).alias("is_known"),
        "consumption",
        "arrival",
        F.sum(F.col("arrival") - F.col("consumption")).over(so_far).alias("change"),
        F.when(counts, overdue).otherwise(F.lit(0)).alias("backlog_qty"),
        F.coalesce(F.date_sub(F.lead("day").over(in_order), 1), end).alias("until"),
    )
    # a run without days is a stock row overtaken by a change on the anchor itself
    return runs.where(F.col("is_known") & (F.col("until") >= F.col("day"))).select(
        "marc_id",
        *ATTRIBUTES,
        "day",
        "until",
        "backlog_qty",
        "consumption",
        "arrival",
        (F.col("available_stock") - F.col("backlog_qty") + F.col("change")).alias("qty"),
    )


def inventory_simulation(runs: DataFrame) -> DataFrame:
    """One row per material and horizon day, unfolded from the runs without a further shuffle."""
    on_first = F.col("calendar_date") == F.col("day")
    return runs.withColumn(
        "calendar_date", F.explode(F.sequence(F.col("day"), F.col("until")))
    ).select(
        "marc_id",
        "material_number",
        "plant",
        "abc_indicator",
        "available_stock",
        "safety_stock",
        "calendar_date",
        "backlog_qty",
        F.when(on_first, F.col("consumption")).otherwise(F.lit(0)).alias("daily_consumption"),
        F.when(on_first, F.col("arrival")).otherwise(F.lit(0)).alias("daily_asn_qty"),
        F.col("qty").alias("simulated_inventory_qty"),
    )


def shortage_report(runs: DataFrame, slowest: DataFrame, p: Params) -> DataFrame:
    """One row per material: red days, and whether any falls inside the slowest transit time.

    Counts and minima are taken over the runs, weighting each by its days, so the daily rows are
    never produced. The runs are already partitioned by material; only ``slowest`` (one row per
    material) is exchanged.
    """
    red = F.col("qty") < 0
    window_end = F.date_add(p.today, F.coalesce(whole("max_tt"), F.lit(0)))
    started = F.col("day") <= F.col("window_end")
    days = F.datediff("until", "day") + 1
    days_in_window = F.datediff(F.least("until", "window_end"), F.col("day")) + 1
    return (
        runs.join(slowest, "marc_id", "left")
        .withColumn("window_end", window_end)
        .groupBy("marc_id")
        .agg(
            F.max("material_number").alias("material_number"),
            F.max("plant").alias("plant"),
            F.max("abc_indicator").alias("abc_class"),
            F.max("available_stock").alias("available_stock"),
            F.max("safety_stock").alias("safety_stock"),
            F.max("backlog_qty").alias("overdue_backlog_qty"),
            F.coalesce(F.max("max_tt"), F.lit(0)).alias("max_tt"),
            F.max("window_end").alias("end_of_tt_gr"),
            F.sum(F.when(red, days).otherwise(0)).alias("red_days"),
            F.sum(F.when(red & started, days_in_window).otherwise(0)).alias("red_days_in_tt"),
            F.min(F.when(started, F.col("qty"))).alias("min_qty_in_tt_gr"),
        )
        .withColumn(
            "status", F.when(F.col("red_days_in_tt") > 0, "Shortage").otherwise("No Shortage")
        )
    )
