"""Staging: rename and type each extract, one row in, one row out.

``STAGING`` holds fixed values: for every staged table its output columns in order, as select
expressions over the source fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runout.functions.columns import OPEN_QTY, QTY, joined_id, parse_date


def text(field: str, name: str) -> Column:
    return F.col(field).alias(name)


def day(field: str, name: str) -> Column:
    return parse_date(field).alias(name)


def qty(field: str, name: str) -> Column:
    return F.col(field).cast(QTY).alias(name)


def open_qty(field: str, name: str) -> Column:
    return F.col(field).cast(OPEN_QTY).alias(name)


def key(left: str, right: str, name: str) -> Column:
    return joined_id(left, right).alias(name)


def difference(left: str, right: str, name: str) -> Column:
    return (F.col(left).cast(QTY) - F.col(right).cast(QTY)).alias(name)


def eket() -> list[Column]:
    return [
        key("ebeln", "ebelp", "ekpo_id"),
        text("ebeln", "po_number"),
        text("ebelp", "po_item"),
        text("etenr", "schedule_line_number"),
        day("eindt", "delivery_date"),
        day("mbdat", "goods_receipt_date"),
        day("wadat", "planned_delivery_date"),
        qty("menge", "scheduled_quantity"),
        qty("wemng", "goods_receipt_quantity"),
        difference("menge", "wemng", "open_quantity"),
    ]


def ekko() -> list[Column]:
    return [
        text("ebeln", "po_number"),
        text("lifnr", "vendor_number"),
        text("ekorg", "purchasing_org"),
        text("ekgrp", "purchasing_group"),
        text("bsart", "po_type"),
        day("bedat", "po_date"),
        text("waers", "currency"),
        text("loekz", "deletion_flag"),
        text("statu", "status"),
        text("inco1", "incoterms_1"),
        text("inco2", "incoterms_2"),
    ]


def ekpo() -> list[Column]:
    return [
        key("ebeln", "ebelp", "ekpo_id"),
        key("matnr", "werks", "marc_id"),
        text("ebeln", "po_number"),
        text("ebelp", "po_item"),
        text("matnr", "material_number"),
        text("werks", "plant"),
        text("matkl", "material_group"),
        qty("menge", "order_quantity"),
        text("meins", "unit_of_measure"),
        qty("netpr", "net_price"),
        qty("netwr", "net_value"),
        text("pstyp", "item_category"),
        text("loekz", "deletion_flag"),
        text("elikz", "delivery_completed_flag"),
    ]


def equk() -> list[Column]:
    return [
        text("matnr", "material_number"),
        text("werks", "plant"),
        text("qunum", "quota_arrangement_number"),
        day("vdatu", "valid_from"),
        day("bdatu", "valid_to"),
        day("erdat", "created_date"),
        qty("scmng", "total_released_quantity"),
    ]


def equp() -> list[Column]:
    return [
        text("qunum", "quota_arrangement_number"),
        text("qupos", "quota_item"),
        text("lifnr", "vendor_number"),
        text("beskz", "procurement_type"),
        qty("quote", "quota"),
        qty("qumng", "quota_usage_quantity"),
        qty("plifz", "planned_delivery_days"),
    ]


def lfa1() -> list[Column]:
    return [
        text("lifnr", "vendor_id"),
        text("lifnr", "vendor_number"),
        text("name1", "vendor_name"),
        text("land1", "country"),
        text("ort01", "city"),
        text("regio", "region"),
        day("erdat", "created_date"),
        text("sperr", "payment_block_flag"),
    ]


def likp() -> list[Column]:
    return [
        text("vbeln", "delivery_number"),
        text("lfart", "delivery_type"),
        text("kunnr", "customer_number"),
        text("vkorg", "sales_org"),
        text("route", "route"),
        day("erdat", "created_date"),
        day("lfdat", "planned_delivery_date"),
        day("wadat", "planned_goods_issue_date"),
        day("wadat_ist", "actual_goods_issue_date"),
        qty("netwr", "net_value"),
        text("waerk", "currency"),
    ]


def lips() -> list[Column]:
    return [
        text("vbeln", "delivery_number"),
        text("posnr", "delivery_item"),
        text("matnr", "material_number"),
        text("matkl", "material_group"),
        text("werks", "plant"),
        text("lgort", "storage_location"),
        text("vgbel", "reference_document"),
        text("vgpos", "reference_item"),
        text("bwart", "movement_type"),
        day("mbdat", "goods_receipt_date"),
        qty("lfimg", "delivery_quantity"),
        qty("netwr", "net_value"),
        text("meins", "unit_of_measure"),
    ]


def marc() -> list[Column]:
    return [
        key("matnr", "werks", "marc_id"),
        text("matnr", "material_number"),
        text("werks", "plant"),
        text("dispo", "mrpc"),
        text("beskz", "procurement_type"),
        qty("webaz", "gr_processing_days"),
        qty("eisbe", "safety_stock"),
        qty("minbe", "reorder_point"),
        text("maabc", "abc_indicator"),
        qty("plifz", "planned_delivery_days"),
        text("ekgrp", "purchasing_group"),
    ]


def mard() -> list[Column]:
    return [
        text("matnr", "material_number"),
        text("werks", "plant"),
        text("lgort", "storage_location"),
        qty("labst", "unrestricted_stock"),
        qty("insme", "quality_inspection_stock"),
        qty("speme", "blocked_stock"),
        qty("umlme", "transfer_stock"),
    ]


def resb() -> list[Column]:
    return [
        text("rsnum", "reservation_number"),
        text("rspos", "reservation_item"),
        text("rsart", "reservation_type"),
        text("matnr", "material_number"),
        text("werks", "plant"),
        text("lgort", "storage_location"),
        text("aufnr", "order_number"),
        text("vbeln", "sales_order_number"),
        day("bddat", "requirement_date"),
        qty("bdmng", "required_quantity"),
        qty("enmng", "withdrawn_quantity"),
        text("meins", "unit_of_measure"),
        text("kzear", "final_issue_flag"),
    ]


def t001w() -> list[Column]:
    return [
        text("werks", "plant"),
        text("name1", "plant_name"),
        text("fabkl", "factory_calendar_key"),
        text("ekorg", "purchasing_org"),
        text("land1", "country"),
        text("ort01", "city"),
    ]


def tfact() -> list[Column]:
    return [
        text("ident", "calendar_id"),
        text("spras", "language"),
        text("ltext", "calendar_name"),
    ]


def vbak() -> list[Column]:
    return [
        text("vbeln", "sales_order_id"),
        day("erdat", "created_date"),
        text("erzet", "created_time"),
        text("ernam", "created_by"),
        text("auart", "sales_document_type"),
        text("kunnr", "customer_number"),
        text("netwr", "net_value"),
        text("waerk", "currency"),
        text("vkorg", "sales_organization"),
        text("vtweg", "distribution_channel"),
        text("spart", "division"),
        text("gbstk", "delivery_status"),
    ]


def vbap() -> list[Column]:
    return [
        text("vbeln", "sales_order_number"),
        text("posnr", "sales_order_item"),
        text("matnr", "material_number"),
        qty("menge", "order_quantity"),
        text("meins", "order_unit"),
        qty("netwr", "net_value"),
        text("waerk", "currency"),
        text("werks", "plant"),
        text("lgort", "storage_location"),
        text("pstyv", "item_category"),
        text("abgru", "rejection_reason"),
        day("erdat", "created_date"),
    ]


def vbbe() -> list[Column]:
    return [
        text("vbeln", "sales_order_number"),
        text("posnr", "sales_order_item"),
        text("matnr", "material_number"),
        text("werks", "plant"),
        text("bdart", "requirement_type"),
        text("auart", "sales_document_type"),
        text("kunnr", "customer_number"),
        day("mbdat", "requirement_date"),
        open_qty("omeng", "open_requirement_qty"),
        open_qty("vmeng", "confirmed_qty"),
        text("meins", "unit_of_measure"),
    ]


def vbup() -> list[Column]:
    return [
        text("vbeln", "document_number"),
        text("posnr", "document_item"),
        text("gbsta", "overall_status"),
        text("abstk", "delivery_block"),
        text("wbstk", "goods_movement_status"),
        text("fkstk", "billing_status"),
        text("lvstk", "goods_issue_status"),
        text("lsstk", "final_delivery_status"),
        text("kosta", "cost_status"),
        text("lfgsk", "credit_status"),
    ]


STAGING = {
    "EKET": eket,
    "EKKO": ekko,
    "EKPO": ekpo,
    "EQUK": equk,
    "EQUP": equp,
    "LFA1": lfa1,
    "LIKP": likp,
    "LIPS": lips,
    "MARC": marc,
    "MARD": mard,
    "RESB": resb,
    "T001W": t001w,
    "TFACT": tfact,
    "VBAK": vbak,
    "VBAP": vbap,
    "VBBE": vbbe,
    "VBUP": vbup,
}


def stage(table: str, extract: DataFrame) -> DataFrame:
    """The typed view of one all-text extract.

    A date text that is not ``YYYYMMDD`` becomes NULL and is counted by the ``date_format`` check.
    """
    return extract.select(STAGING[table]())
