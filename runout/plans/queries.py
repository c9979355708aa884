"""The registered queries: one per operator, over the extracts of the driver's order tables."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runout.functions.calendar import add_working_days
from runout.operators import demand, integrity, quality, serving
from runout.operators.supply import PARTIES
from runout.plans.lineage import Planning
from runout.session import shuffles_removed, tune
from runout.sources import extracts as extract_files
from runout.sources.lanes import lane_matrix, read_lanes
from runout.fixtures import faults
from runout.fixtures.order_tables import (
    DAYS_FROM_NATION,
    DAYS_TO_PLANT,
    PARAMS,
    OrderTableExtracts,
)
from runout.sources.schemas import EXTRACTS, LANES
from runout.sources.sinks import Tables, layer_of, scratch_folder

# the material that the single-material look-up is asked for
SHOWN_MATERIAL = "000000000000000001-1001"

# tables that the detail supply stores on its way, and the columns of them that are read again (all if none are
# given)
DETAIL_TABLES: dict[str, tuple[str, ...]] = {
    "int_purchasing_document_timed": (),
    "int_tt_quota": (),
    "int_sa_future": (
        *PARTIES,
        "delivery_date",
        "transit_time_days",
        "open_quantity",
        "planned_availability_date",
    ),
    "int_supply": (),
    "int_partial_detail_supply": (),
}
# the order in which it composes the frames that store them, and the tables that nothing reads afterwards
DETAIL_STEPS: dict[str, tuple[str, ...]] = {
    "transit_quota": (),
    "open_schedule": ("int_purchasing_document_timed",),
    "supply": ("int_sa_future", "int_announced"),
    "supply_context": ("int_supply", "int_tt_quota", "MARC"),
}

Query = Callable[[SparkSession, str], DataFrame]


@lru_cache(maxsize=8)
def planning(spark: SparkSession, folder: str) -> Planning:
    """The lazy frames of one session and folder, composed once and shared by the queries."""
    extracts = OrderTableExtracts(tune(spark), folder)
    return Planning(extracts, extracts.lanes(), PARAMS)


def stored_planning(spark: SparkSession, folder: str, root: str) -> Planning:
    """As ``planning``, over the extracts loaded as tables under ``root`` first."""
    derived = OrderTableExtracts(tune(spark), folder)
    tables = Tables(spark, root)
    lanes = tables.write("seed_transit_time", derived.lanes(), LANES)
    return Planning(extract_files.load(tables, derived), lanes, PARAMS)


def edge(df: DataFrame) -> DataFrame:
    """Decimals as doubles, shares and averages to 6 places: scales differ between engines."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if f.name in ("quote_percent", "avg_otd"):
            c = F.round(c, 6)
        columns.append(c.alias(f.name))
    return df.select(columns)


def _seed(p: Planning) -> DataFrame:
    """The lanes written as a seed file and read from it."""
    spark = p.lanes.sparkSession
    path = f"{scratch_folder(spark)}/seed_transit_time.csv"
    p.lanes.write.option("header", True).csv(path)
    return read_lanes(spark, path)


def _available_date(p: Planning) -> DataFrame:
    """Reservations with the day on which they could be met by goods received when required."""
    lines = (
        p.stg("RESB")
        .select(
            "reservation_number", "reservation_item", "material_number", "plant", "requirement_date"
        )
        .join(
            p.stg("MARC").select("material_number", "plant", "gr_processing_days"),
            ["material_number", "plant"],
            "left",
        )
    )
    return add_working_days(
        lines, p.calendar_index, "requirement_date", "gr_processing_days", "available_date"
    )


def _stored_extracts(p: Planning, stamps: dict[str, list[str]]) -> str:
    """Write extracts as CSV folders; those before the last stamp of a table hold every row twice."""
    spark = p.lanes.sparkSession
    root = scratch_folder(spark)
    for table, dates in stamps.items():
        for stamp in dates:
            df = p.extracts[table]
            if stamp != dates[-1]:
                df = df.unionAll(df)
            df.write.option("header", True).option("escape", '"').csv(
                f"{root}/{table}/{table}_{stamp}.csv"
            )
    return root


def _extract_latest(p: Planning) -> DataFrame:
    spark = p.lanes.sparkSession
    root = _stored_extracts(
        p, {"LFA1": ["19991231", "20000103"], "RESB": ["19991201", "20000103"]}
    )
    latest = extract_files.extract_latest(spark, root).select("table_name", "stamp")
    tables = Tables(spark, scratch_folder(spark))
    loaded = extract_files.load(tables, extract_files.read_extracts(spark, root))
    return latest.join(extract_files.load_audit(tables, loaded), "table_name")


def _load_audit(p: Planning) -> DataFrame:
    """The audit of a load of all extracts."""
    tables = Tables(p.lanes.sparkSession, scratch_folder(p.lanes.sparkSession))
    return extract_files.load_audit(tables, extract_files.load(tables, p.extracts))


def _bronze_read(p: Planning) -> DataFrame:
    root = _stored_extracts(p, {"RESB": ["20000103"]})
    return extract_files.read_extracts(p.lanes.sparkSession, root)["RESB"]


def _bronze_write(p: Planning) -> DataFrame:
    """Written twice: the second refresh replaces the first."""
    spark = p.lanes.sparkSession
    tables = Tables(spark, scratch_folder(spark))
    for _ in range(2):
        stored = tables.write("LFA1", p.extracts["LFA1"], EXTRACTS["LFA1"])
    return stored


def _layer_tables(p: Planning) -> DataFrame:
    """A table of every stored layer, written by name and counted where the layer keeps it."""
    spark = p.lanes.sparkSession
    root = scratch_folder(spark)
    tables = Tables(spark, root)
    frames = {
        "MARC": p.extracts["MARC"],
        "int_pn_infor": p.material_stock_context,
        "mart_consumption": p.consumption,
    }
    for name, df in frames.items():
        tables.write(name, df)
    return quality.all_of(
        [
            Tables(spark, root)
            .read(name)
            .agg(F.count("*").alias("n_rows"))
            .select(F.lit(layer_of(name)).alias("layer"), F.lit(name).alias("table_name"), "n_rows")
            for name in frames
        ]
    )


def _filter_options(p: Planning) -> DataFrame:
    return quality.all_of(
        [
            serving.filter_options(p.shortage_report, column).select(
                F.lit(column).alias("filter"), F.col(column).alias("option")
            )
            for column in ("plant", "abc_class")
        ]
    )


def _supply_planning(p: Planning) -> Planning:
    """The same lazy frames over announced deliveries that are stored: the supply reads them three times."""
    tables = Tables(p.lanes.sparkSession, scratch_folder(p.lanes.sparkSession))
    return p.over_announced(tables.write("int_announced", p.announced))


def _detail_supply(p: Planning) -> DataFrame:
    """Over a stored supply context, whose parts are stored one after the other.

    A step's shuffles are removed once it is stored, and a stored table once its last reader is, so that disk
    holds one step's shuffles and what is still to be read, not all that was ever shuffled. The material master
    is stored as well, as three of the steps read it.
    """
    spark = p.lanes.sparkSession
    tables = Tables(spark, scratch_folder(spark))

    def keep(name: str, df: DataFrame) -> DataFrame:
        if name not in DETAIL_TABLES:
            return df
        return tables.write(name, df.select(*DETAIL_TABLES[name] or df.columns))

    with shuffles_removed(spark):
        master = tables.write("MARC", p.extracts["MARC"], EXTRACTS["MARC"])
        plan = Planning(ChainMap({"MARC": master}, p.extracts), p.lanes, p.params)
        plan = plan.over_announced(tables.write("int_announced", plan.announced), keep)
        for frame, read in DETAIL_STEPS.items():
            getattr(plan, frame)  # composed, and so stored, when it is first asked for
            for name in read:
                tables.remove(name)
    return p.detail_supply_from(plan.supply_context)


STAGED = (
    "EKET EKKO EKPO EQUK EQUP LFA1 LIKP LIPS MARC MARD RESB T001W TFACT VBAK VBAP VBBE VBUP"
).split()

FRAMES: dict[str, Callable[[Planning], DataFrame]] = {
    # sources and sinks
    "seed_transit_time": _seed,
    "lane_matrix": lambda p: lane_matrix(p.extracts["LFA1"], DAYS_FROM_NATION, DAYS_TO_PLANT),
    "load_audit": _load_audit,
    "extract_latest": _extract_latest,
    "bronze_read": _bronze_read,
    "bronze_write": _bronze_write,
    "layer_tables": _layer_tables,
    # staging
    **{f"stg_{t.lower()}": (lambda p, t=t: p.stg(t)) for t in STAGED},
    # material context and calendar
    "material_base": lambda p: p.material_base,
    "material_stock_context": lambda p: p.material_stock_context,
    "factory_calendar": lambda p: p.factory_calendar,
    "working_calendar": lambda p: p.working_calendar,
    "add_working_days": _available_date,
    # quota and transit time
    "quota_header_active": lambda p: p.quota_header_active,
    "quota_item": lambda p: p.quota_item,
    "quota_share": lambda p: p.quota_share,
    "transit_time": lambda p: p.transit_time,
    "transit_quota": lambda p: p.transit_quota,
    # purchasing
    "po_active": lambda p: p.po_active,
    "po_transit_quota": lambda p: p.po_transit_quota,
    "schedule_by_date": lambda p: p.schedule_by_date,
    "scheduling_agreement": lambda p: p.scheduling_agreement,
    "open_schedule": lambda p: p.open_schedule,
    "late_shipment": lambda p: p.late_shipment,
    # deliveries
    "inbound_deliveries": lambda p: p.inbound_deliveries,
    "asn_status": lambda p: p.asn_status,
    # demand
    "demand_union": lambda p: p.demand_union,
    "demand_valid": lambda p: p.demand_valid,
    "overdue_by_material": lambda p: demand.overdue_by_material(
        p.demand_union, p.material_base, PARAMS
    ),
    "overdue_by_type": lambda p: demand.overdue_by_type(
        p.demand_union, p.material_base, PARAMS
    ),
    "future_demand": lambda p: demand.future_demand(p.demand_union, p.demand_by_type, PARAMS),
    "backlog": lambda p: p.backlog,
    # supply
    "supply": lambda p: _supply_planning(p).supply,
    "supply_context": lambda p: _supply_planning(p).supply_context,
    "supply_gap_fill": lambda p: p.supply_gap_fill,
    # marts
    "detail_supply": _detail_supply,
    "consumption": lambda p: p.consumption,
    "inventory_simulation": lambda p: p.inventory_simulation,
    "shortage_report": lambda p: p.shortage_report,
    "vendor_performance": lambda p: p.vendor_performance,
    # dashboard queries
    "shortage_ranked": lambda p: serving.shortage_ranked(p.shortage_report),
    "simulation_for_material": lambda p: serving.simulation_for_material(
        p.inventory_simulation, SHOWN_MATERIAL
    ),
    "vendors_ranked": lambda p: serving.vendors_ranked(p.vendor_performance),
    "consumption_trend": lambda p: serving.consumption_trend(p.consumption),
    "top_demand_materials": lambda p: serving.top_demand_materials(p.consumption),
    "backlog_by_plant": lambda p: serving.backlog_by_plant(p.shortage_report),
    "shortage_filtered": lambda p: serving.shortage_filtered(
        p.shortage_report, "1001", "C", "Shortage", "[1-5]$"
    ),
    "filter_options": _filter_options,
    "overview_kpis": lambda p: serving.overview_kpis(p.shortage_report),
    "red_zone": lambda p: serving.red_zone(
        p.inventory_simulation, p.shortage_report, SHOWN_MATERIAL
    ),
    "red_zones": lambda p: serving.red_zone(p.inventory_simulation, p.shortage_report),
    "vendor_kpis": lambda p: serving.vendor_kpis(p.vendor_performance),
    "vendors_bottom10": lambda p: serving.vendors_bottom(p.vendor_performance),
    "vendor_band": lambda p: serving.vendor_band(p.vendor_performance),
    "demand_kpis": lambda p: serving.demand_kpis(p.consumption, p.shortage_report),
    "weekly_demand": lambda p: serving.weekly_demand(p.consumption),
    # model tests
    "dq_unique": lambda p: quality.dq_unique(
        faults.repeated_tables(p.model_tables(set(quality.UNIQUE)), quality.UNIQUE),
        quality.UNIQUE,
    ),
    "dq_not_null": lambda p: quality.dq_not_null(
        faults.blanked_tables(p.model_tables(set(quality.NOT_NULL))), quality.NOT_NULL
    ),
    "dq_accepted_values": lambda p: quality.dq_accepted_values(
        faults.unaccepted_tables(p.model_tables({t for t, _ in quality.ACCEPTED_VALUES})),
        quality.ACCEPTED_VALUES,
    ),
    "dq_unique_combo": lambda p: quality.dq_unique_combo(
        faults.repeated_tables(
            p.model_tables(set(quality.UNIQUE_COMBINATIONS)), quality.UNIQUE_COMBINATIONS
        ),
        quality.UNIQUE_COMBINATIONS,
    ),
    "dq_rate_range": lambda p: quality.dq_rate_range(
        faults.changed(p.vendor_performance, "otd_rate", "vendor_number", F.lit(1.5))
    ),
    "dq_null_projection": lambda p: quality.dq_null_projection(
        faults.changed(p.inventory_simulation, "simulated_inventory_qty", "marc_id")
    ),
    "dq_negative_transit": lambda p: quality.dq_negative_transit(
        faults.changed(p.transit_quota, "max_tt", "marc_id", F.lit(-1))
    ),
    "dq_negative_red_days": lambda p: quality.dq_negative_red_days(
        faults.changed(p.shortage_report, "red_days", "marc_id", F.lit(-1))
    ),
    # extract checks
    "fk_orphans": lambda p: integrity.fk_orphans(p.extracts),
    "fk_orphans_composite": lambda p: integrity.fk_orphans_composite(p.extracts),
    "pk_nulls": lambda p: integrity.pk_nulls(
        faults.Spoilt(p.extracts, faults.KEYS)
    ),
    "pk_duplicates": lambda p: integrity.pk_duplicates(p.extracts),
    "date_format": lambda p: integrity.date_format(
        faults.Spoilt(p.extracts, faults.DATES)
    ),
    "id_length": lambda p: integrity.id_length(p.extracts),
    "constant_value": lambda p: integrity.constant_value(
        faults.Spoilt(p.extracts, faults.CONSTANTS)
    ),
    "over_receipt": lambda p: integrity.over_receipt(
        faults.Spoilt(p.extracts, faults.RECEIVED)
    ),
    "early_receipt": lambda p: integrity.early_receipt(
        faults.Spoilt(p.extracts, faults.RECEIVED), PARAMS
    ),
    "value_tolerance": lambda p: integrity.value_tolerance(p.extracts),
    "receipt_in_future": lambda p: integrity.receipt_in_future(p.extracts, PARAMS),
    "asn_status_conflict": lambda p: integrity.asn_status_conflict(
        faults.Spoilt(p.extracts, faults.ARRIVED)
    ),
    "open_qty_positive": lambda p: integrity.open_qty_positive(
        faults.Spoilt(p.extracts, faults.NOT_OPEN)
    ),
    "future_demand_share": lambda p: integrity.future_demand_share(p.extracts, PARAMS),
    "future_supply_count": lambda p: integrity.future_supply_count(p.extracts, PARAMS),
    "pareto_share": lambda p: integrity.pareto_share(p.extracts),
    "active_quota_share": lambda p: integrity.active_quota_share(p.extracts, PARAMS),
    "min_volume": lambda p: integrity.min_volume(p.extracts),
}


def _query(frame: Callable[[Planning], DataFrame]) -> Query:
    return lambda spark, folder: edge(frame(planning(spark, folder)))


QUERIES: dict[str, Query] = {name: _query(frame) for name, frame in FRAMES.items()}
