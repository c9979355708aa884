"""Vendor scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runout.functions.columns import sum_where, zero_if_null
from runout.operators.inbound import RECEIVED


def vendor_performance(
    vendors: DataFrame,
    deliveries: DataFrame,
    ekko: DataFrame,
    lines: DataFrame,
    transit: DataFrame,
) -> DataFrame:
    """Every vendor with on-time delivery, late schedule lines and average transit time.

    ``deliveries`` needs reference order, receipt day, promised day and status only. Orders count
    even when deleted. Each figure is aggregated to one row per vendor before it is joined.
    """
    order = ekko.select(F.col("po_number").alias("reference_document"), "vendor_number")
    on_time = F.col("gr_date") <= F.col("planned_delivery_date_hdr")
    received = (
        deliveries.where(F.col("goods_movement_status") == RECEIVED)
        .join(order, "reference_document")
        .groupBy("vendor_number")
        .agg(
            F.count("*").alias("completed_delivery_lines"),
            F.count_if(on_time).alias("on_time_lines"),
        )
    )
    is_late = F.col("late_shipment_flag") == 1
    late = lines.groupBy("vendor_number").agg(
        F.count_if(is_late).alias("late_shipment_lines"),
        sum_where(is_late, "order_qty_due").alias("late_qty_due"),
    )
    # exact decimal average: a double could round a half the other way
    average = F.sum("transit_time_days").cast("decimal(18,0)") / F.count("transit_time_days")
    lane = transit.groupBy("vendor_number").agg(F.round(average, 1).alias("avg_transit_time_days"))
    rate = F.col("on_time_lines").cast("decimal(18,0)") / F.col("completed_delivery_lines")
    return (
        vendors.select("vendor_number", "vendor_name", "country")
        .join(received, "vendor_number", "left")
        .join(late, "vendor_number", "left")
        .join(lane, "vendor_number", "left")
        .select(
            "vendor_number",
            "vendor_name",
            "country",
            zero_if_null("completed_delivery_lines").alias("completed_delivery_lines"),
            zero_if_null("on_time_lines").alias("on_time_lines"),
            F.round(rate, 3).alias("otd_rate"),
            zero_if_null("late_shipment_lines").alias("late_shipment_lines"),
            zero_if_null("late_qty_due").alias("late_qty_due"),
            "avg_transit_time_days",
        )
    )
