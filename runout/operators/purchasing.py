"""Purchase orders, schedule lines and their coverage by announced deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runout.functions.calendar import add_working_days
from runout.functions.columns import joined_id, whole
from runout.params import Params

# deletion flags that take an order or an item out of planning
DELETED = ["L", "S", "X"]


def po_active(ekko: DataFrame, ekpo: DataFrame) -> DataFrame:
    """Order items whose header and item both carry no deletion flag; NULL counts as none."""
    live = ~F.coalesce(F.col("deletion_flag"), F.lit("")).isin(DELETED)
    headers = ekko.where(live).select(
        "po_number", "vendor_number", "purchasing_org", "po_type", "po_date"
    )
    items = ekpo.where(live).select(
        "ekpo_id", "po_number", "po_item", "material_number", "plant", "order_quantity"
    )
    return headers.join(items, "po_number").select(
        "ekpo_id",
        "po_number",
        "vendor_number",
        "purchasing_org",
        "po_item",
        joined_id("material_number", "plant").alias("marc_id"),
        "material_number",
        "plant",
        "po_type",
        "po_date",
        "order_quantity",
    )


def with_lane(orders: DataFrame, lanes: DataFrame) -> DataFrame:
    """Order items with what the lanes hold for their (vendor, plant, purchasing org)."""
    return orders.join(lanes, ["vendor_number", "plant", "purchasing_org"], "left")


def po_transit_quota(
    orders: DataFrame,
    lanes: DataFrame,
    plants: DataFrame,
    shares: DataFrame,
    keep_timed: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Order items with the transit time of their lane, its calendar and the vendor's quota share.

    ``lanes`` are the bare ``lane_days``: one projection of a stored table, whose size Spark knows, so
    that it broadcasts them while they are small and order items are not shuffled by their few lanes.
    The calendar belongs to the plant and is attached afterwards, where there is a lane. Several active
    arrangements for one (material, plant, vendor) are reduced to the largest share first, so the
    join cannot multiply order items. ``keep_timed`` may store the items that have their transit time and
    calendar but no share yet.
    """
    share = shares.groupBy("material_number", "plant", "vendor_number").agg(
        F.max("quote_percent").alias("quote_percent")
    )
    calendars = plants.select("plant", "factory_calendar_key")
    with_days = with_lane(orders, lanes.withColumn("has_lane", F.lit(True)))
    timed = (
        with_days.join(calendars, "plant", "left")
        .withColumn("factory_calendar_key", F.when(F.col("has_lane"), F.col("factory_calendar_key")))
        .select(*orders.columns, "transit_time_days", "factory_calendar_key")
    )
    return (
        keep_timed(timed)
        .join(share, ["material_number", "plant", "vendor_number"], "left")
        .select(*orders.columns, "transit_time_days", "factory_calendar_key", "quote_percent")
    )


def schedule_by_date(eket: DataFrame) -> DataFrame:
    """Schedule lines summed per (order item, delivery date).

    The item id follows from order and item number, so it is left out of the shuffled key.
    """
    return (
        eket.groupBy("po_number", "po_item", "delivery_date")
        .agg(
            F.min("goods_receipt_date").alias("goods_receipt_date"),
            F.sum("scheduled_quantity").alias("scheduled_quantity"),
            F.sum("goods_receipt_quantity").alias("goods_receipt_quantity"),
            F.sum("open_quantity").alias("open_quantity"),
        )
        .select(
            joined_id("po_number", "po_item").alias("ekpo_id"),
            "po_number",
            "po_item",
            "delivery_date",
            "goods_receipt_date",
            "scheduled_quantity",
            "goods_receipt_quantity",
            "open_quantity",
        )
    )


def scheduling_agreement(orders: DataFrame, schedule: DataFrame) -> DataFrame:
    """Active order items with their schedule, one row per (item, delivery date)."""
    return orders.select(
        "ekpo_id",
        "po_number",
        "vendor_number",
        "purchasing_org",
        "po_type",
        "po_date",
        "marc_id",
        "material_number",
        "plant",
    ).join(schedule.drop("po_number"), "ekpo_id").select(
        "po_number",
        "vendor_number",
        "purchasing_org",
        "po_type",
        "po_date",
        "marc_id",
        "material_number",
        "plant",
        "ekpo_id",
        "po_item",
        "delivery_date",
        "goods_receipt_date",
        "scheduled_quantity",
        "goods_receipt_quantity",
        "open_quantity",
    )


def open_lines(
    orders: DataFrame, schedule: DataFrame, marc: DataFrame, index: DataFrame
) -> DataFrame:
    """Schedule lines with an open quantity and the day on which it becomes available.

    ``orders`` are order items, with whatever columns the reader wants to keep: transit time and
    share are looked up per item, before the items meet their lines. The available day is the
    delivery day plus the goods-receipt working days; outside the calendar plain days are added
    instead. Past delivery days stay: they are overdue supply.
    """
    lines = orders.join(
        schedule.where("open_quantity > 0").drop("po_number", "po_item", "goods_receipt_date"),
        "ekpo_id",
    ).join(marc.select("marc_id", "gr_processing_days"), "marc_id", "left")
    plain = F.date_add("delivery_date", F.coalesce(whole("gr_processing_days"), F.lit(0)))
    return (
        add_working_days(lines, index, "delivery_date", "gr_processing_days", "pad")
        .withColumn("planned_availability_date", F.coalesce("pad", plain))
        .drop("pad")
    )


def open_schedule(lines: DataFrame, vendors: DataFrame) -> DataFrame:
    """Open lines with the name of their vendor."""
    return lines.join(
        vendors.select("vendor_number", "vendor_name", "country"), "vendor_number", "left"
    ).select(
        "ekpo_id",
        "po_number",
        "po_item",
        "vendor_number",
        "vendor_name",
        "country",
        "purchasing_org",
        "po_type",
        "po_date",
        "marc_id",
        "material_number",
        "plant",
        "delivery_date",
        "scheduled_quantity",
        "goods_receipt_quantity",
        "open_quantity",
        "gr_processing_days",
        "transit_time_days",
        "quote_percent",
        "planned_availability_date",
    )


def running_announced(future_deliveries: DataFrame, p: Params) -> DataFrame:
    """Per (material, vendor): what has arrived by each day, in an array with one entry per day.

    ``first`` is the day of entry 0, counted from the anchor: the first day with a delivery; the last
    entry is the last such day. Deliveries are summed per day before anything is gathered, so the window
    and the array hold at most one entry per day between the anchor and the end of the calendar. Each total
    fills the days up to the next one, which makes the array dense without looking at it again.
    """
    daily = (
        future_deliveries.where(
            "marc_id IS NOT NULL AND vendor_number IS NOT NULL AND planned_availability_date IS NOT NULL"
        )
        .groupBy(
            "marc_id", "vendor_number", days_since(p, "planned_availability_date").alias("day")
        )
        .agg(F.sum("delivery_quantity").alias("qty"))
    )
    by_day = Window.partitionBy("marc_id", "vendor_number").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("qty").over(so_far).cast(daily.schema["qty"].dataType)
    lasts = F.coalesce(F.lead("day").over(by_day) - F.col("day"), F.lit(1))
    filled = daily.select(
        "marc_id", "vendor_number", "day", F.array_repeat(total, lasts).alias("totals")
    )
    return filled.groupBy("marc_id", "vendor_number").agg(
        F.min("day").alias("first"),
        F.flatten(F.sort_array(F.collect_list(F.struct("day", "totals")))["totals"]).alias("totals"),
    )


def days_since(p: Params, day: str) -> Column:
    """Days from the anchor to ``day``, negative before it."""
    return F.datediff(F.col(day), p.today)


def late_shipment(lines: DataFrame, future_deliveries: DataFrame, p: Params) -> DataFrame:
    """How much of each open line is covered by deliveries announced for no later than its day.

    The as-of side is small: per (material, vendor) an array of running totals by day. Lines meet it in a
    plain equi-join, so Spark can broadcast it or split a hot key, and no group of lines is ever gathered.
    A line's total is one look-up at its day's distance from the array's first day; later days than the
    last have the last total, days before the first have none. NULL keys or days match nothing. One
    delivery may cover several lines.
    """
    announced = running_announced(future_deliveries, p)
    place = days_since(p, "planned_availability_date") - F.col("first")
    covered = F.get("totals", F.least(place, F.size("totals") - 1))
    still_due = F.col("open_quantity") - F.col("cumulative_asn_qty")
    arrives_by = F.date_add("delivery_date", F.coalesce(F.col("transit_time_days"), F.lit(0)))
    late = (arrives_by >= p.today) & (F.col("order_qty_due") > 0)
    return (
        lines.join(announced, ["marc_id", "vendor_number"], "left")
        .withColumn(
            "cumulative_asn_qty", F.coalesce(F.when(place.isNotNull(), covered), F.lit(0))
        )
        .select(*lines.columns, "cumulative_asn_qty")
        .withColumn("order_qty_due", still_due)
        .withColumn("late_shipment_flag", F.when(late, 1).otherwise(0))
    )
