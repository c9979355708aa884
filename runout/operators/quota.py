"""Quota arrangements and transit times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runout.functions.columns import SHARE
from runout.params import Params


def quota_header_active(equk: DataFrame, p: Params) -> DataFrame:
    """Quota headers whose validity contains the anchor; overlapping headers are all kept."""
    return equk.where(p.today.between(F.col("valid_from"), F.col("valid_to"))).drop("created_date")


def quota_item(equp: DataFrame) -> DataFrame:
    return equp


def quota_share(headers: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """Each vendor's share of its arrangement: quota over the arrangement's total, NULL when 0.

    The items' total is a pre-aggregated join rather than a window, so that an arrangement with very many
    items is summed map-side instead of being gathered in one task. An item counts once per active
    header of its arrangement, as it does in the joined rows. These headers, overlapping validities of one
    arrangement, are counted in a window: it shares the exchange of the joins and reads the headers once.
    """
    number = "quota_arrangement_number"
    n_headers = F.count("*").over(Window.partitionBy(number))
    totals = items.groupBy(number).agg(F.sum("quota").alias("item_total"))
    counted = (
        headers.where(F.col(number).isNotNull())
        .select(number, "material_number", "plant", "valid_from", "valid_to")
        .withColumn("n_headers", n_headers)
        .join(totals, number)
        .withColumn("total", F.col("item_total") * F.col("n_headers"))
    )
    share = F.col("quota") / F.nullif(F.col("total"), F.lit(0))
    return (
        counted.join(
            items.select(
                number,
                "quota_item",
                "vendor_number",
                "procurement_type",
                "quota",
                "planned_delivery_days",
            ),
            number,
        )
        .join(vendors.select("vendor_number", "vendor_name", "country"), "vendor_number", "left")
        .select(
            number,
            "material_number",
            "plant",
            "valid_from",
            "valid_to",
            "quota_item",
            "vendor_number",
            "vendor_name",
            "country",
            "procurement_type",
            "quota",
            "planned_delivery_days",
            share.cast(SHARE).alias("quote_percent"),
        )
    )


def lane_days(lanes: DataFrame) -> DataFrame:
    """Transit days per (vendor, purchasing org, plant), for the readers that need no names."""
    return lanes.selectExpr(
        "lifnr AS vendor_number", "ekorg AS purchasing_org", "werks AS plant", "transit_time_days"
    )


def transit_time(lanes: DataFrame, vendors: DataFrame, plants: DataFrame) -> DataFrame:
    """Lanes with the names of their vendor and plant; unknown names are NULL."""
    return (
        lane_days(lanes)
        .join(vendors.select("vendor_number", "vendor_name", "country"), "vendor_number", "left")
        .join(plants.select("plant", "plant_name", "factory_calendar_key"), "plant", "left")
        .select(
            "vendor_number",
            "purchasing_org",
            "plant",
            "vendor_name",
            "country",
            "plant_name",
            "factory_calendar_key",
            "transit_time_days",
        )
    )


def transit_quota(orders: DataFrame) -> DataFrame:
    """Transit days and share per (material, vendor), and the slowest vendor of the material.

    The window runs over rows already reduced to one per (material, vendor): a partition holds at
    most one row per vendor, however many order lines the material has.
    """
    return (
        orders.groupBy("marc_id", "vendor_number")
        .agg(
            F.max("transit_time_days").alias("transit_time_days"),
            F.max("quote_percent").alias("quote_percent"),
        )
        .withColumn("max_tt", F.max("transit_time_days").over(Window.partitionBy("marc_id")))
    )


def slowest_transit(orders: DataFrame) -> DataFrame:
    """Transit days of the slowest vendor per material: ``max_tt`` without the vendor rows."""
    return orders.groupBy("marc_id").agg(F.max("transit_time_days").alias("max_tt"))
