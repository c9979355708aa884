"""Consolidated supply: open schedule lines and announced deliveries, made continuous by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runout.functions.calendar import at_day, with_calendar
from runout.functions.columns import OPEN_QTY, SHARE
from runout.operators.quality import dealt
from runout.params import Params

ORDERED = "Order Qty"
ANNOUNCED = "ASN"

PARTIES = ["marc_id", "material_number", "plant", "vendor_number", "vendor_name", "country"]


def supply(lines: DataFrame, announced: DataFrame) -> DataFrame:
    """Open schedule lines and future deliveries in one shape; other deliveries stay out."""
    ordered = lines.select(
        F.lit(ORDERED).alias("supply_type"),
        *PARTIES,
        "planned_availability_date",
        F.col("open_quantity").cast(OPEN_QTY).alias("order_qty"),
        F.col("order_qty_due").cast(OPEN_QTY).alias("order_qty_due"),
        F.col("cumulative_asn_qty").cast(OPEN_QTY).alias("fulfill_qty"),
    )
    underway = announced.where("asn_status = 'future'").select(
        F.lit(ANNOUNCED).alias("supply_type"),
        *PARTIES,
        "planned_availability_date",
        F.col("delivery_quantity").cast(OPEN_QTY).alias("order_qty"),
        F.col("asn_total_due_qty").cast(OPEN_QTY).alias("order_qty_due"),
        F.lit(None).cast(OPEN_QTY).alias("fulfill_qty"),
    )
    return ordered.unionByName(underway)


def dated_supply(lines: DataFrame, future_deliveries: DataFrame) -> DataFrame:
    """Who supplies what on which day, without quantities."""
    day = "planned_availability_date"
    ordered = lines.select(F.lit(ORDERED).alias("supply_type"), *PARTIES, day)
    underway = future_deliveries.select(F.lit(ANNOUNCED).alias("supply_type"), *PARTIES, day)
    return ordered.unionByName(underway).where(F.col(day).isNotNull())


def supply_context(
    supplies: DataFrame, stock: DataFrame, transit: DataFrame, index: DataFrame
) -> DataFrame:
    """Dated supply with stock, transit, quota and calendar context."""
    context = stock.select(
        "marc_id", "available_stock", "safety_stock", "abc_indicator", "gr_processing_days"
    )
    dated = (
        supplies.where("planned_availability_date IS NOT NULL")
        .join(context, "marc_id", "left")
        .join(transit, ["marc_id", "vendor_number"], "left")
    )
    return with_calendar(dated, index).select(
        "supply_type",
        *PARTIES,
        "planned_availability_date",
        "order_qty",
        "order_qty_due",
        "fulfill_qty",
        "available_stock",
        "safety_stock",
        "abc_indicator",
        "gr_processing_days",
        "transit_time_days",
        "quote_percent",
        "max_tt",
        at_day("day_flags", "planned_availability_date").alias("is_workingday"),
        at_day("day_numbers", "planned_availability_date").alias("technical_day_number"),
    )


def supply_gap_fill(dated: DataFrame, index: DataFrame, p: Params) -> DataFrame:
    """Zero rows for the horizon days on which an ordered (material, vendor) pair has no supply.

    Takes any frame with supply type, parties and available day. One aggregation, combined map-side,
    gathers the distinct parties and days (at most the horizon's length) of a pair, so the supply is read
    once and nothing is joined but the calendars; the missing days are exploded from them and the
    pairs-by-days grid is never joined or shuffled. As a pair grows to a hundred times its size, pairs are
    dealt to a number of tasks that Spark does not merge by their size before. A delivery on a day also
    blocks the fill, an unknown vendor's or material's days block nothing, and parties without a plant have
    no calendar and so no days.
    """
    day = F.col("planned_availability_date")
    pair = ["marc_id", "vendor_number"]
    in_horizon = day.between(p.today, F.lit(p.grid_end))
    known = F.col("marc_id").isNotNull() & F.col("vendor_number").isNotNull()
    ordered = (F.col("supply_type") == ORDERED) & F.col("plant").isNotNull()
    others = [c for c in PARTIES if c not in pair]
    gathered = (
        dated.where(ordered | (in_horizon & known))
        .groupBy(*pair)
        .agg(
            F.collect_set(F.when(ordered, F.struct(*others))).alias("parties"),
            F.collect_set(F.when(in_horizon & known, day)).alias("supplied"),
        )
        .where(F.size("parties") > 0)
    )
    pairs = (
        dealt(gathered, *pair)
        .select(*pair, "supplied", F.explode("parties").alias("party"))
        .select(*pair, "supplied", "party.*")
    )
    grid = F.sequence(F.lit(p.anchor), F.lit(p.grid_end))
    nothing = {
        "fulfill_qty": OPEN_QTY,
        "available_stock": "decimal(20,2)",
        "safety_stock": "decimal(10,2)",
        "abc_indicator": "string",
        "gr_processing_days": "decimal(10,2)",
        "transit_time_days": "int",
        "quote_percent": SHARE,
        "max_tt": "int",
    }
    days = pairs.join(index, F.col("plant") == F.col("calendar_plant")).withColumn(
        "planned_availability_date", F.explode(F.array_except(grid, "supplied"))
    )
    return days.select(
        F.lit(ORDERED).alias("supply_type"),
        *PARTIES,
        "planned_availability_date",
        F.lit(0).cast(OPEN_QTY).alias("order_qty"),
        F.lit(0).cast(OPEN_QTY).alias("order_qty_due"),
        *[F.lit(None).cast(t).alias(name) for name, t in nothing.items()],
        at_day("day_flags", "planned_availability_date").alias("is_workingday"),
        at_day("day_numbers", "planned_availability_date").alias("technical_day_number"),
    )


def detail_supply(dated: DataFrame, fill: DataFrame) -> DataFrame:
    return dated.unionByName(fill)
