"""Inbound deliveries and the ones still announced (not yet fully received)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runout.functions.calendar import add_working_days
from runout.functions.columns import sum_where
from runout.params import Params

RECEIVED = "C"


def receipt_day():
    """The earlier of creation and actual goods issue; creation while nothing was issued."""
    return F.coalesce(F.least("created_date", "actual_goods_issue_date"), F.col("created_date"))


def delivery_lines(likp: DataFrame, lips: DataFrame, vbup: DataFrame) -> DataFrame:
    """Delivery items with their header's dates and their goods-movement status."""
    header = likp.select(
        "delivery_number",
        "delivery_type",
        "created_date",
        F.col("planned_delivery_date").alias("planned_delivery_date_hdr"),
        "actual_goods_issue_date",
        receipt_day().alias("gr_date"),
    )
    item = lips.drop("net_value")
    status = vbup.select(
        F.col("document_number").alias("delivery_number"),
        F.col("document_item").alias("delivery_item"),
        "goods_movement_status",
    )
    return header.join(item, "delivery_number").join(
        status, ["delivery_number", "delivery_item"], "left"
    )


def inbound_deliveries(
    likp: DataFrame, lips: DataFrame, vbup: DataFrame, marc: DataFrame
) -> DataFrame:
    """Delivery items with status and planning data; unknown materials keep NULL planning data."""
    material = marc.select("material_number", "plant", "marc_id", "gr_processing_days")
    return (
        delivery_lines(likp, lips, vbup)
        .join(material, ["material_number", "plant"], "left")
        .select(
            "delivery_number",
            "delivery_type",
            "created_date",
            "planned_delivery_date_hdr",
            "actual_goods_issue_date",
            "gr_date",
            "delivery_item",
            "material_number",
            "plant",
            "material_group",
            "storage_location",
            "reference_document",
            "reference_item",
            "movement_type",
            "goods_receipt_date",
            "delivery_quantity",
            "unit_of_measure",
            "goods_movement_status",
            "marc_id",
            "gr_processing_days",
        )
    )


def announced_deliveries(deliveries: DataFrame, index: DataFrame, p: Params) -> DataFrame:
    """Deliveries not fully received, with the day they become available and how that stands.

    No status counts as not received. Outside the calendar there is no day: 'pending'.
    """
    open_lines = deliveries.where(
        F.coalesce(F.col("goods_movement_status"), F.lit("")) != RECEIVED
    )
    day = F.col("planned_availability_date")
    return add_working_days(
        open_lines, index, "gr_date", "gr_processing_days", "planned_availability_date"
    ).withColumn(
        "asn_status",
        F.when(day.isNull(), "pending").when(day >= p.today, "future").otherwise("overdue"),
    )


def with_vendor(announced: DataFrame, ekko: DataFrame) -> DataFrame:
    """A delivery carries no vendor: take it from the order the delivery item refers to."""
    order = ekko.select(F.col("po_number").alias("reference_document"), "vendor_number")
    return announced.join(order, "reference_document", "left")


def asn_status(announced: DataFrame, ekko: DataFrame, vendors: DataFrame) -> DataFrame:
    """Announced deliveries with vendor and the material's total overdue and pending quantity.

    The total is aggregated map-side and joined back (NULL-safe, so that deliveries of unknown
    materials share one total), which no hot material can pull into a single task.
    """
    due = announced.groupBy(F.col("marc_id").alias("due_marc_id")).agg(
        sum_where(F.col("asn_status").isin("overdue", "pending"), "delivery_quantity").alias(
            "asn_total_due_qty"
        )
    )
    return (
        with_vendor(announced, ekko)
        .join(vendors.select("vendor_number", "vendor_name", "country"), "vendor_number", "left")
        .join(due, F.col("marc_id").eqNullSafe(F.col("due_marc_id")), "left")
        .select(
            "delivery_number",
            "delivery_item",
            "delivery_type",
            "marc_id",
            "material_number",
            "plant",
            "vendor_number",
            "vendor_name",
            "country",
            "created_date",
            "planned_delivery_date_hdr",
            "gr_date",
            "gr_processing_days",
            "delivery_quantity",
            "goods_movement_status",
            "planned_availability_date",
            "asn_status",
            "asn_total_due_qty",
        )
    )
