"""The planning run as named frames, each composed from the ones it reads.

A frame is built when it is first asked for, and only what it depends on is built with it. A full
refresh passes ``keep``, which stores each frame under its table name and reads it back. Without it
everything stays lazy, and frames with several readers are composed for each of them from no more
than it needs: ``stored`` tells the two apart. ``READS`` says which frames and extracts each frame needs
when they are stored, so that a refresh can build those that do not wait for each other at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from runout.functions import calendar
from runout.operators import (
    demand,
    inbound,
    materials,
    projection,
    purchasing,
    quota,
    staging,
    supply,
    vendors,
)
from runout.params import Params

Keep = Callable[[str, DataFrame], DataFrame]

#: Every stored frame with the stored frames and the extracts (in capitals) that it reads.
READS: dict[str, tuple[str, ...]] = {
    "material_base": ("MARC",),
    "material_stock_context": ("material_base", "MARD"),
    "factory_calendar": ("T001W",),
    "working_calendar": ("factory_calendar",),
    "quota_header_active": ("EQUK",),
    "quota_item": ("EQUP",),
    "quota_share": ("quota_header_active", "quota_item", "LFA1"),
    "transit_time": ("LFA1", "T001W"),
    "po_active": ("EKKO", "EKPO"),
    "po_transit_quota": ("po_active", "quota_share", "T001W"),
    "transit_quota": ("po_transit_quota",),
    "schedule_by_date": ("EKET",),
    "scheduling_agreement": ("po_active", "schedule_by_date"),
    "open_schedule": ("po_transit_quota", "schedule_by_date", "factory_calendar", "MARC", "LFA1"),
    "inbound_deliveries": ("LIKP", "LIPS", "VBUP", "MARC"),
    "asn_status": ("inbound_deliveries", "factory_calendar", "EKKO", "LFA1"),
    "late_shipment": ("open_schedule", "asn_status"),
    "backlog": ("material_base", "RESB", "VBBE"),
    "supply": ("late_shipment", "asn_status"),
    "supply_context": ("supply", "material_stock_context", "transit_quota", "factory_calendar"),
    "supply_gap_fill": ("supply_context", "factory_calendar"),
    "detail_supply": ("supply_context", "supply_gap_fill"),
    "consumption": ("material_base", "RESB", "VBBE"),
    "stock_runs": ("material_stock_context", "asn_status", "RESB", "VBBE", "T001W"),
    "inventory_simulation": ("stock_runs",),
    "shortage_report": ("stock_runs", "po_transit_quota"),
    "vendor_performance": ("inbound_deliveries", "late_shipment", "LFA1", "EKKO"),
}


class Planning:
    def __init__(
        self,
        extracts: Mapping[str, DataFrame],
        lanes: DataFrame,
        params: Params,
        keep: Keep | None = None,
    ):
        self.extracts = extracts
        self.lanes = lanes
        self.params = params
        self.stored = keep is not None
        self.keep: Keep = keep or (lambda name, df: df)
        self._staged: dict[str, DataFrame] = {}

    def stg(self, table: str) -> DataFrame:
        if table not in self._staged:
            self._staged[table] = staging.stage(table, self.extracts[table])
        return self._staged[table]

    # -- material context and calendar

    @cached_property
    def material_base(self) -> DataFrame:
        return self.keep("int_material_bbm", materials.material_base(self.stg("MARC")))

    @cached_property
    def material_stock_context(self) -> DataFrame:
        return self.keep(
            "int_pn_infor",
            materials.material_stock_context(self.material_base, self.stg("MARD")),
        )

    @cached_property
    def factory_calendar(self) -> DataFrame:
        return self.keep(
            "int_factory_calendar", calendar.factory_calendar(self.stg("T001W"), self.params)
        )

    @cached_property
    def working_calendar(self) -> DataFrame:
        return self.keep("int_working_calendar", calendar.working_calendar(self.factory_calendar))

    @cached_property
    def calendar_index(self) -> DataFrame:
        return calendar.calendar_index(self.factory_calendar)

    # -- quota and transit time

    @cached_property
    def quota_header_active(self) -> DataFrame:
        return self.keep(
            "int_equk_active", quota.quota_header_active(self.stg("EQUK"), self.params)
        )

    @cached_property
    def quota_item(self) -> DataFrame:
        return self.keep("int_equp_active", quota.quota_item(self.stg("EQUP")))

    @cached_property
    def quota_share(self) -> DataFrame:
        return self.keep(
            "int_valid_quote_agreements",
            quota.quota_share(self.quota_header_active, self.quota_item, self.stg("LFA1")),
        )

    @cached_property
    def transit_time(self) -> DataFrame:
        return self.keep(
            "int_transit_time",
            quota.transit_time(self.lanes, self.stg("LFA1"), self.stg("T001W")),
        )

    @cached_property
    def transit_quota(self) -> DataFrame:
        return self.keep("int_tt_quota", quota.transit_quota(self.po_transit_quota))

    # -- purchasing

    @cached_property
    def po_active(self) -> DataFrame:
        return self.keep(
            "int_purchasing_document_active",
            purchasing.po_active(self.stg("EKKO"), self.stg("EKPO")),
        )

    @cached_property
    def po_transit_quota(self) -> DataFrame:
        return self.keep(
            "int_purchasing_document_tt",
            purchasing.po_transit_quota(
                self.po_active,
                quota.lane_days(self.lanes),
                self.stg("T001W"),
                self.quota_share,
                self._keep_timed,
            ),
        )

    def _keep_timed(self, orders: DataFrame) -> DataFrame:
        """Order items before they have a quota share; a refresh stores them with it only."""
        return orders if self.stored else self.keep("int_purchasing_document_timed", orders)

    @cached_property
    def schedule_by_date(self) -> DataFrame:
        return self.keep("int_sa_by_delivery_date", purchasing.schedule_by_date(self.stg("EKET")))

    @cached_property
    def scheduling_agreement(self) -> DataFrame:
        return self.keep(
            "int_scheduling_agreement",
            purchasing.scheduling_agreement(self.po_active, self.schedule_by_date),
        )

    def open_lines(self, orders: DataFrame) -> DataFrame:
        return purchasing.open_lines(
            orders, self.schedule_by_date, self.stg("MARC"), self.calendar_index
        )

    @cached_property
    def open_schedule(self) -> DataFrame:
        return self.keep(
            "int_sa_future",
            purchasing.open_schedule(self.open_lines(self.po_transit_quota), self.stg("LFA1")),
        )

    @cached_property
    def late_shipment(self) -> DataFrame:
        return self.keep(
            "int_sa_late_shipment",
            purchasing.late_shipment(self.open_schedule, self.future_deliveries, self.params),
        )

    @cached_property
    def late_lines(self) -> DataFrame:
        """Late shipments for the readers that need neither vendor names nor quota shares."""
        if self.stored:
            return self.late_shipment
        orders = purchasing.with_lane(self.po_active, quota.lane_days(self.lanes))
        return purchasing.late_shipment(
            self.open_lines(orders), self.future_deliveries, self.params
        )

    # -- deliveries

    @cached_property
    def inbound_deliveries(self) -> DataFrame:
        return self.keep(
            "int_inbound_deliveries",
            inbound.inbound_deliveries(
                self.stg("LIKP"), self.stg("LIPS"), self.stg("VBUP"), self.stg("MARC")
            ),
        )

    @cached_property
    def announced(self) -> DataFrame:
        """Announced deliveries for the readers that need neither vendor nor totals."""
        if self.stored:
            return self.asn_status
        return self._announced

    @cached_property
    def _announced(self) -> DataFrame:
        return inbound.announced_deliveries(
            self.inbound_deliveries, self.calendar_index, self.params
        )

    def over_announced(self, announced: DataFrame, keep: Keep | None = None) -> Planning:
        """The lazy frames over announced deliveries that the caller has stored.

        Their own rows, the totals of their material and the coverage of the lines are read from them.
        ``keep`` may store some frames: unlike in a refresh, each is still composed as the lazy one, so that
        the rows are the same whichever of them it stores.
        """
        plan = Planning(self.extracts, self.lanes, self.params)
        plan._announced = announced
        if keep is not None:
            plan.keep = keep
        return plan

    @cached_property
    def future_deliveries(self) -> DataFrame:
        """Future deliveries with their vendor's number."""
        future = self.announced.where("asn_status = 'future'")
        return future if self.stored else inbound.with_vendor(future, self.stg("EKKO"))

    @cached_property
    def asn_status(self) -> DataFrame:
        return self.keep(
            "int_inbound_deliveries_asn",
            inbound.asn_status(self._announced, self.stg("EKKO"), self.stg("LFA1")),
        )

    # -- demand

    @cached_property
    def demand_union(self) -> DataFrame:
        return demand.demand_union(self.stg("RESB"), self.stg("VBBE"))

    @cached_property
    def demand_valid(self) -> DataFrame:
        return demand.demand_valid(self.demand_union, self.material_base)

    @cached_property
    def demand_by_type(self) -> DataFrame:
        return demand.demand_by_type(self.demand_union, self.material_base, self.params)

    @cached_property
    def backlog(self) -> DataFrame:
        return self.keep(
            "int_backlog", demand.backlog(self.demand_union, self.material_base, self.params)
        )

    # -- supply

    @cached_property
    def supply(self) -> DataFrame:
        return self.keep("int_supply", supply.supply(self.late_shipment, self.asn_status))

    @cached_property
    def supply_context(self) -> DataFrame:
        return self.keep(
            "int_partial_detail_supply",
            supply.supply_context(
                self.supply, self.material_stock_context, self.transit_quota, self.calendar_index
            ),
        )

    @cached_property
    def dated_supply(self) -> DataFrame:
        """Type, parties and available day of the dated supply: all that the gap fill reads.

        Needs neither the coverage of the lines nor stock, transit or quota context.
        """
        if self.stored:
            return self.supply_context
        names = self.stg("LFA1").select("vendor_number", "vendor_name", "country")
        return supply.dated_supply(
            self.open_lines(self.po_active).join(names, "vendor_number", "left"),
            self.future_deliveries.join(names, "vendor_number", "left"),
        )

    @cached_property
    def supply_gap_fill(self) -> DataFrame:
        return self.keep(
            "int_fill_missing_dates_supply",
            supply.supply_gap_fill(self.dated_supply, self.calendar_index, self.params),
        )

    # -- marts

    @cached_property
    def detail_supply(self) -> DataFrame:
        """Supply and the days without any."""
        return self.keep(
            "mart_detail_supply", supply.detail_supply(self.supply_context, self.supply_gap_fill)
        )

    def detail_supply_from(self, context: DataFrame) -> DataFrame:
        """The mart and its gap fill from one supply context, which the caller has stored.

        The context, a few joins of every line, is far smaller than the mart. Without a stored one it is
        composed for both of its readers.
        """
        fill = supply.supply_gap_fill(context, self.calendar_index, self.params)
        return supply.detail_supply(context, fill)

    @cached_property
    def consumption(self) -> DataFrame:
        return self.keep(
            "mart_consumption",
            demand.consumption(self.demand_union, self.material_base, self.params),
        )

    @cached_property
    def stock_runs(self) -> DataFrame:
        return self.keep(
            "int_stock_runs",
            projection.stock_runs(
                self.material_stock_context,
                self.demand_union,
                self.announced,
                self.stg("T001W"),
                self.params,
            ),
        )

    @cached_property
    def inventory_simulation(self) -> DataFrame:
        runs = self.stock_runs
        if self.stored:  # a task may read several files, each of them in order
            runs = runs.sortWithinPartitions("marc_id", "day")
        return self.keep("mart_inventory_simulation", projection.inventory_simulation(runs))

    @cached_property
    def slowest_transit(self) -> DataFrame:
        if self.stored:
            return quota.slowest_transit(self.po_transit_quota)
        return quota.slowest_transit(
            purchasing.with_lane(self.po_active, quota.lane_days(self.lanes))
        )

    @cached_property
    def shortage_report(self) -> DataFrame:
        return self.keep(
            "mart_shortage_report",
            projection.shortage_report(self.stock_runs, self.slowest_transit, self.params),
        )

    @cached_property
    def vendor_performance(self) -> DataFrame:
        if self.stored:
            deliveries = self.inbound_deliveries
        else:
            deliveries = inbound.delivery_lines(
                self.stg("LIKP"), self.stg("LIPS"), self.stg("VBUP")
            )
        return self.keep(
            "mart_vendor_performance",
            vendors.vendor_performance(
                self.stg("LFA1"),
                deliveries,
                self.stg("EKKO"),
                self.late_lines,
                quota.lane_days(self.lanes),
            ),
        )

    # -- what the model tests read

    def model_tables(self, names: Iterable[str]) -> dict[str, DataFrame]:
        """The frames the model tests read, by table name; only the named ones are composed."""
        frames = {
            "stg_marc": lambda: self.stg("MARC"),
            "stg_ekko": lambda: self.stg("EKKO"),
            "stg_ekpo": lambda: self.stg("EKPO"),
            "stg_vbup": lambda: self.stg("VBUP"),
            "stg_likp": lambda: self.stg("LIKP"),
            "int_pn_infor": lambda: self.material_stock_context,
            "int_factory_calendar": lambda: self.factory_calendar,
            "int_working_calendar": lambda: self.working_calendar,
            "int_inbound_deliveries_asn": lambda: self.announced,
            "int_tt_quota": lambda: self.transit_quota,
            "mart_shortage_report": lambda: self.shortage_report,
            "mart_inventory_simulation": lambda: self.inventory_simulation,
            "mart_consumption": lambda: self.consumption,
            "mart_vendor_performance": lambda: self.vendor_performance,
        }
        return {name: frames[name]() for name in names}
