"""Material master and stock context, one row per material and plant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runout.functions.columns import zero_if_null

MATERIAL_COLUMNS = [
    "marc_id",
    "material_number",
    "plant",
    "mrpc",
    "procurement_type",
    "gr_processing_days",
    "safety_stock",
    "reorder_point",
    "abc_indicator",
    "planned_delivery_days",
    "purchasing_group",
]

# The columns of the stock context, in order, before the stock columns.
CONTEXT_COLUMNS = [
    "marc_id",
    "material_number",
    "plant",
    "gr_processing_days",
    "safety_stock",
    "procurement_type",
    "mrpc",
    "reorder_point",
    "abc_indicator",
    "planned_delivery_days",
    "purchasing_group",
]

# stock column of the context -> stock bucket summed over the storage locations
STOCK_BUCKETS = {
    "available_stock": "unrestricted_stock",
    "blocked_stock_s": "blocked_stock",
    "blocked_stock_q": "quality_inspection_stock",
}


def material_base(marc: DataFrame) -> DataFrame:
    return marc.select(MATERIAL_COLUMNS)


def material_stock_context(materials: DataFrame, mard: DataFrame) -> DataFrame:
    """Materials with their stock; 0 where a material has no stock row."""
    stock = mard.groupBy("material_number", "plant").agg(
        *[F.sum(bucket).alias(name) for name, bucket in STOCK_BUCKETS.items()]
    )
    return materials.join(stock, ["material_number", "plant"], "left").select(
        *CONTEXT_COLUMNS, *[zero_if_null(name).alias(name) for name in STOCK_BUCKETS]
    )
