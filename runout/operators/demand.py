"""Open demand, overdue demand and the demand inside the planning horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runout.functions.columns import OPEN_QTY, joined_id, sum_where
from runout.params import Params

RESERVATIONS = "RESB"
REQUIREMENTS = "VBBE"


def demand_union(resb: DataFrame, vbbe: DataFrame) -> DataFrame:
    """Reservations still to be withdrawn and all open sales requirements, tagged by source."""
    to_withdraw = F.col("required_quantity") - F.col("withdrawn_quantity")
    reservations = resb.where(to_withdraw > 0).select(
        F.col("reservation_number").alias("customer_order"),
        F.col("reservation_item").alias("co_item"),
        F.col("reservation_type").alias("requirement_type"),
        joined_id("material_number", "plant").alias("marc_id"),
        "material_number",
        "plant",
        "requirement_date",
        to_withdraw.cast(OPEN_QTY).alias("demand_qty"),
        F.lit(RESERVATIONS).alias("demand_source"),
    )
    requirements = vbbe.select(
        F.col("sales_order_number").alias("customer_order"),
        F.col("sales_order_item").alias("co_item"),
        "requirement_type",
        joined_id("material_number", "plant").alias("marc_id"),
        "material_number",
        "plant",
        "requirement_date",
        F.col("open_requirement_qty").cast(OPEN_QTY).alias("demand_qty"),
        F.lit(REQUIREMENTS).alias("demand_source"),
    )
    return reservations.unionByName(requirements)


def demand_valid(demand: DataFrame, materials: DataFrame) -> DataFrame:
    """Demand for materials of the material master."""
    return demand.join(materials.select("marc_id"), "marc_id", "left_semi").select(demand.columns)


def _known(reduced: DataFrame, materials: DataFrame) -> DataFrame:
    """Drop unknown materials from rows already reduced by material: few rows meet the join."""
    return reduced.join(materials.select("marc_id"), "marc_id", "left_semi")


def overdue_by_type(demand: DataFrame, materials: DataFrame, p: Params) -> DataFrame:
    """Demand dated before the anchor per (material, source, requirement type), 0 if none."""
    overdue = sum_where(F.col("requirement_date") < p.today, "demand_qty")
    return _known(
        demand.groupBy("marc_id", "demand_source", "requirement_type").agg(
            overdue.alias("backlog_per_pn_contype")
        ),
        materials,
    )


def overdue_by_material(demand: DataFrame, materials: DataFrame, p: Params) -> DataFrame:
    """Demand dated before the anchor per material, 0 if none."""
    overdue = sum_where(F.col("requirement_date") < p.today, "demand_qty")
    return _known(demand.groupBy("marc_id").agg(overdue.alias("backlog_per_pn")), materials)


def in_horizon(p: Params):
    return F.col("requirement_date").between(p.today, F.lit(p.horizon_end))


def demand_by_type(demand: DataFrame, materials: DataFrame, p: Params) -> DataFrame:
    """Overdue quantity and last requirement date per (material, source, type)."""
    return _known(
        demand.groupBy("marc_id", "demand_source", "requirement_type").agg(
            sum_where(F.col("requirement_date") < p.today, "demand_qty").alias(
                "backlog_per_pn_contype"
            ),
            F.max("requirement_date").alias("last_date"),
        ),
        materials,
    )


def future_demand(demand: DataFrame, by_type: DataFrame, p: Params) -> DataFrame:
    """Demand lines of the horizon with the overdue quantity of their material and of their type.

    ``by_type`` is the result of ``demand_by_type``. The material's quantity is summed over its
    rows there (a handful: one per source and type), and only materials with demand from the
    anchor on are looked up. Every line's (material, source, type) occurs in it, so one NULL-safe
    inner join brings both figures and drops the unknown materials; a NULL requirement type has
    no overdue quantity of its own.
    """
    material = Window.partitionBy("marc_id")
    overdue = (
        by_type.select(
            F.col("marc_id").alias("o_marc_id"),
            F.col("demand_source").alias("o_demand_source"),
            F.col("requirement_type").alias("o_requirement_type"),
            "backlog_per_pn_contype",
            F.sum("backlog_per_pn_contype").over(material).alias("backlog_per_pn"),
            F.max("last_date").over(material).alias("last_material_date"),
        )
        .where(F.col("last_material_date") >= p.today)
        .drop("last_material_date")
    )
    same = (
        (F.col("marc_id") == F.col("o_marc_id"))
        & (F.col("demand_source") == F.col("o_demand_source"))
        & F.col("requirement_type").eqNullSafe(F.col("o_requirement_type"))
    )
    of_type = F.when(F.col("requirement_type").isNull(), F.lit(0)).otherwise(
        F.col("backlog_per_pn_contype")
    )
    return (
        demand.where(in_horizon(p))
        .join(overdue, same)
        .select(
            "marc_id",
            "customer_order",
            "co_item",
            "demand_source",
            "requirement_type",
            "material_number",
            "plant",
            "requirement_date",
            "demand_qty",
            "backlog_per_pn",
            of_type.alias("backlog_per_pn_contype"),
        )
    )


def overdue_only(by_type: DataFrame, p: Params) -> DataFrame:
    """Materials with overdue demand and no demand at all from the anchor on."""
    return (
        by_type.groupBy("marc_id")
        .agg(
            F.sum("backlog_per_pn_contype").alias("backlog_per_pn"),
            F.max("last_date").alias("last_date"),
        )
        .where((F.col("backlog_per_pn") > 0) & (F.col("last_date") < p.today))
        .select("marc_id", "backlog_per_pn")
    )


def backlog(demand: DataFrame, materials: DataFrame, p: Params) -> DataFrame:
    """Future demand lines, plus one otherwise empty row per material with overdue demand only.

    A material whose only demand from the anchor on lies past the horizon gets no row at all.
    Unknown materials are dropped.
    """
    by_type = demand_by_type(demand, materials, p)
    lines = future_demand(demand, by_type, p)
    empty = overdue_only(by_type, p).withColumn(
        "backlog_per_pn_contype", F.lit(0).cast(lines.schema["backlog_per_pn_contype"].dataType)
    )
    return lines.unionByName(empty, allowMissingColumns=True)


def consumption(demand: DataFrame, materials: DataFrame, p: Params) -> DataFrame:
    """Daily demand per material over the horizon.

    Unknown materials are dropped after the aggregation: the join then meets at most one row per
    material and day, whatever the number of demand lines.
    """
    return (
        demand.where(in_horizon(p))
        .groupBy("marc_id", "requirement_date")
        .agg(F.sum("demand_qty").alias("daily_consumption"))
        .join(materials.select("marc_id", "material_number", "plant"), "marc_id")
        .select("marc_id", "material_number", "plant", "requirement_date", "daily_consumption")
    )
