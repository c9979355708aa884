"""All-text extracts derived from the order tables (region .. lineitem parquet).

The rules are those of ``FIXTURES.md``: they turn order lines into stock, demand, orders, schedule
lines and deliveries in such a way that every branch of the planning logic occurs (orphans, missing
stock rows, deleted orders, days outside the calendar, missing status, expired quotas). Each table
is derived from the whole of its source tables, by projections and grouped aggregations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from runout.params import Params
from runout.sources.lanes import lane_matrix
from runout.sources.schemas import EXTRACTS

PARAMS = Params(anchor=date(2000, 1, 3))
N_NATIONS = 25
# Fixed values of the derivation: transit days from a nation, extra days to a plant.
DAYS_FROM_NATION = {f"NATION_{i}": 3 + i % 5 * 6 for i in range(N_NATIONS)}
DAYS_TO_PLANT = {
    str(1000 + i): {1001: 1, 1002: 2, 1003: 1}.get(1000 + i, 0) for i in range(N_NATIONS)
}


def dats(day: str) -> str:
    """A date as ``YYYYMMDD`` text."""
    return f"replace(CAST({day} AS STRING), '-', '')"


def padded(column: str, width: int) -> str:
    return f"lpad(CAST({column} AS STRING), {width}, '0')"


def text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


class OrderTableExtracts(Mapping):
    """Extract frames by table name, each derived when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str, p: Params = PARAMS):
        self.spark = spark
        self.folder = folder
        self.today = f"DATE '{p.anchor}'"
        self._frames: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}
        self._rules: dict[str, Callable[[], DataFrame]] = {
            t: getattr(self, t.lower()) for t in EXTRACTS
        }

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._frames:
            frame = self._rules[table]()
            given = set(frame.columns)
            self._frames[table] = frame.selectExpr(
                *[
                    c if c in given else f"CAST(NULL AS STRING) AS {c}"
                    for c in EXTRACTS[table].fieldNames()
                ]
            )
        return self._frames[table]

    def __iter__(self) -> Iterator[str]:
        return iter(self._rules)

    def __len__(self) -> int:
        return len(self._rules)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with their ids and a day folded into anchor-400 .. anchor+139."""
        since = "datediff(to_date(l_shipdate), DATE '1995-01-01')"
        return self.table("lineitem").selectExpr(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
            f"date_add({self.today}, {since} % 540 - 400) AS fd",
            text("1000 + (l_partkey + l_orderkey % 2) % 4") + " AS werks",
            padded("l_partkey", 18) + " AS matnr",
            padded("l_suppkey", 10) + " AS lifnr",
            "concat(l_orderkey, '/', l_suppkey) AS po",
            "CAST(l_quantity AS DECIMAL(10,2)) AS q",
        )

    @cached_property
    def ordered(self) -> DataFrame:
        return self.lines.where("l_returnflag = 'N'")

    @cached_property
    def announced(self) -> DataFrame:
        return self.ordered.where(f"l_tax < 0.05 AND fd < date_add({self.today}, 60)").selectExpr(
            "*", f"concat(po, '/', {dats('fd')}) AS vbeln"
        )

    def lanes(self) -> DataFrame:
        return lane_matrix(self["LFA1"], DAYS_FROM_NATION, DAYS_TO_PLANT)

    # -- master data

    def t001w(self) -> DataFrame:
        return self.table("nation").selectExpr(
            text("1000 + n_nationkey") + " AS werks",
            "concat('Plant ', 1000 + n_nationkey) AS name1",
            padded("n_nationkey % 3 + 1", 2) + " AS fabkl",
            "'1000' AS ekorg",
            "n_name AS land1",
            "concat('City ', n_nationkey) AS ort01",
        )

    def tfact(self) -> DataFrame:
        return (
            self.table("nation")
            .selectExpr(padded("n_nationkey % 3 + 1", 2) + " AS ident")
            .distinct()
            .selectExpr("ident", "explode(array('E', 'D')) AS spras")
            .selectExpr("ident", "spras", "concat('Calendar ', ident, ' ', spras) AS ltext")
        )

    def lfa1(self) -> DataFrame:
        nation = self.table("nation").selectExpr(
            "n_nationkey AS s_nationkey", "n_name", "n_regionkey"
        )
        return (
            self.table("supplier")
            .join(nation, "s_nationkey")
            .selectExpr(
                padded("s_suppkey", 10) + " AS lifnr",
                "n_name AS land1",
                "s_name AS name1",
                "concat('City ', s_suppkey % 7) AS ort01",
                text("n_regionkey") + " AS regio",
                "'19980101' AS erdat",
                "CASE WHEN s_acctbal < 0 THEN 'X' END AS sperr",
            )
        )

    def kna1(self) -> DataFrame:
        return self.table("customer").selectExpr(
            padded("c_custkey", 10) + " AS kunnr",
            "c_name AS name1",
            text("c_nationkey") + " AS land1",
        )

    def mara(self) -> DataFrame:
        return self.table("part").selectExpr(
            "'100' AS mandt",
            padded("p_partkey", 18) + " AS matnr",
            "p_type AS mtart",
            "'EA' AS meins",
            "'19980101' AS ersda",
        )

    @cached_property
    def material_plants(self) -> DataFrame:
        """The (part, plant) pairs of the order lines; every 40th part has no master record."""
        return (
            self.lines.where("l_partkey % 40 <> 39")
            .selectExpr("l_partkey", "(l_partkey + l_orderkey % 2) % 4 AS place")
            .distinct()
            .selectExpr(
                "l_partkey",
                padded("l_partkey", 18) + " AS matnr",
                text("1000 + place") + " AS werks",
            )
        )

    @cached_property
    def sized_material_plants(self) -> DataFrame:
        part = self.table("part").selectExpr("p_partkey AS l_partkey", "p_size")
        return self.material_plants.join(part, "l_partkey")

    def marc(self) -> DataFrame:
        return self.sized_material_plants.selectExpr(
            "matnr",
            "werks",
            "concat('G', l_partkey % 3) AS ekgrp",
            "concat('M', l_partkey % 5) AS dispo",
            text("2 * p_size") + " AS minbe",
            text("p_size") + " AS eisbe",
            "CASE WHEN l_partkey % 20 < 17 THEN 'F' WHEN l_partkey % 20 < 19 THEN 'E' ELSE 'X' END"
            " AS beskz",
            text("5 + l_partkey % 20") + " AS plifz",
            text("l_partkey % 4") + " AS webaz",
            "CASE WHEN p_size <= 5 THEN 'A' WHEN p_size <= 15 THEN 'B' ELSE 'C' END AS maabc",
        )

    def mard(self) -> DataFrame:
        return (
            self.sized_material_plants.where("l_partkey % 25 <> 3")
            .selectExpr("*", "explode(array('0001', '0002')) AS lgort")
            .selectExpr(
                "matnr",
                "werks",
                "lgort",
                text("if(lgort = '0001', 2, 1) * p_size") + " AS labst",
                "'0' AS umlme",
                text("l_partkey % 3") + " AS insme",
                text("l_partkey % 5") + " AS speme",
            )
        )

    # -- quotas

    def equk(self) -> DataFrame:
        until = (
            f"if(l_partkey % 10 = 9, date_sub({self.today}, 10),"
            f" date_add({self.today}, int(60 + l_partkey % 300)))"
        )
        since = f"date_sub({self.today}, int(60 + l_partkey % 340))"
        return self.material_plants.where("l_partkey % 20 < 17").selectExpr(
            "matnr",
            "werks",
            "concat(matnr, '-', werks) AS qunum",
            f"{dats(since)} AS vdatu",
            f"{dats(until)} AS bdatu",
            "'0' AS scmng",
            "'19990101' AS erdat",
        )

    def equp(self) -> DataFrame:
        return (
            self.ordered.selectExpr(
                "l_partkey", "(l_partkey + l_orderkey % 2) % 4 AS place", "l_suppkey"
            )
            .distinct()
            .selectExpr(
                f"concat({padded('l_partkey', 18)}, '-', 1000 + place) AS qunum",
                padded("l_suppkey", 10) + " AS qupos",
                "'F' AS beskz",
                padded("l_suppkey", 10) + " AS lifnr",
                text("if(l_partkey % 30 = 1, 0, 10 + l_suppkey % 50)") + " AS quote",
                "'0' AS qumng",
                text("l_suppkey % 30") + " AS plifz",
            )
        )

    # -- sales and demand

    def vbak(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "'100' AS mandt",
            padded("o_orderkey", 10) + " AS vbeln",
            dats("to_date(o_orderdate)") + " AS erdat",
            "'120000' AS erzet",
            "'TA' AS auart",
            padded("o_custkey", 10) + " AS kunnr",
            text("CAST(o_totalprice AS DECIMAL(12,2))") + " AS netwr",
            "'EUR' AS waerk",
            "o_orderstatus AS gbstk",
        )

    def vbap(self) -> DataFrame:
        return self.lines.selectExpr(
            padded("l_orderkey", 10) + " AS vbeln",
            padded("l_linenumber", 6) + " AS posnr",
            "matnr",
            text("q") + " AS menge",
            "'EA' AS meins",
            text("q * 10") + " AS netwr",
            "'EUR' AS waerk",
            "werks",
            dats("fd") + " AS erdat",
        )

    def resb(self) -> DataFrame:
        withdrawn = f"if(fd < {self.today} AND l_tax < 0.075, q, CAST(0 AS DECIMAL(10,2)))"
        return self.lines.where("l_returnflag = 'R'").selectExpr(
            text("l_orderkey") + " AS rsnum",
            text("l_linenumber") + " AS rspos",
            "CASE l_linenumber % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'N' END AS rsart",
            "matnr",
            "werks",
            text("q") + " AS bdmng",
            text(withdrawn) + " AS enmng",
            "'EA' AS meins",
            dats("fd") + " AS bddat",
        )

    def vbbe(self) -> DataFrame:
        return (
            self.lines.where("l_returnflag = 'A'")
            .where(f"fd >= {self.today} OR l_tax >= 0.075")
            .selectExpr(
                padded("l_orderkey", 10) + " AS vbeln",
                padded("l_linenumber", 6) + " AS posnr",
                "matnr",
                "werks",
                dats("fd") + " AS mbdat",
                text("q") + " AS omeng",
                "'0' AS vmeng",
                "'EA' AS meins",
                "CASE l_linenumber % 4 WHEN 0 THEN 'KE' WHEN 1 THEN 'KEL' WHEN 2 THEN 'LSF' END"
                " AS bdart",
            )
        )

    # -- purchasing

    def ekko(self) -> DataFrame:
        return (
            self.ordered.select("l_orderkey", "l_suppkey")
            .distinct()
            .selectExpr(
                "'100' AS mandt",
                "concat(l_orderkey, '/', l_suppkey) AS ebeln",
                "'LP' AS bsart",
                padded("l_suppkey", 10) + " AS lifnr",
                "'1000' AS ekorg",
                "'19990101' AS bedat",
                "'EUR' AS waers",
                "CASE WHEN l_orderkey % 50 = 0 THEN 'L' END AS loekz",
            )
        )

    def ekpo(self) -> DataFrame:
        """One item per order and part; every 100th order is priced 10 % off its quantity."""
        price = "(10 + l_partkey % 90)"
        value = f"if(l_orderkey % 100 = 13, menge * {price} * 11 / 10, menge * {price})"
        return (
            self.ordered.groupBy("l_orderkey", "l_suppkey", "l_partkey")
            .agg({"q": "sum"})
            .withColumnRenamed("sum(q)", "menge")
            .selectExpr(
                "concat(l_orderkey, '/', l_suppkey) AS ebeln",
                text("l_partkey") + " AS ebelp",
                padded("l_partkey", 18) + " AS matnr",
                text("1000 + (l_partkey + l_orderkey % 2) % 4") + " AS werks",
                text("menge") + " AS menge",
                "'EA' AS meins",
                text(price) + " AS netpr",
                text(f"CAST({value} AS DECIMAL(18,2))") + " AS netwr",
                "CASE WHEN l_partkey % 50 = 7 THEN 'X' END AS loekz",
            )
        )

    def eket(self) -> DataFrame:
        day = f"if(l_orderkey % 89 = 0, date_sub({self.today}, 800), fd)"
        received = (
            f"CASE WHEN fd >= {self.today} THEN 0 WHEN l_linestatus = 'F' THEN q"
            " ELSE floor(q / 2) END"
        )
        return self.ordered.selectExpr(
            "po AS ebeln",
            text("l_partkey") + " AS ebelp",
            text("l_linenumber") + " AS etenr",
            f"{dats(day)} AS eindt",
            text("q") + " AS menge",
            text(f"CAST({received} AS DECIMAL(10,2))") + " AS wemng",
            f"{dats(day)} AS mbdat",
            f"{dats(day)} AS wadat",
        )

    # -- deliveries

    def likp(self) -> DataFrame:
        created = (
            f"if(l_orderkey % 97 = 0, date_sub({self.today}, 800),"
            " date_add(fd, int(l_suppkey % 7 - 4)))"
        )
        return (
            self.announced.select("l_orderkey", "l_suppkey", "fd")
            .distinct()
            .selectExpr(
                f"concat(l_orderkey, '/', l_suppkey, '/', {dats('fd')}) AS vbeln",
                "'EL' AS lfart",
                f"{dats(created)} AS erdat",
                f"{dats('fd')} AS lfdat",
                f"{dats('fd')} AS wadat",
                f"if(fd < {self.today}, {dats(created)}, NULL) AS wadat_ist",
                "'0' AS netwr",
            )
        )

    def lips(self) -> DataFrame:
        return (
            self.announced.groupBy("l_orderkey", "l_suppkey", "l_partkey", "fd")
            .agg({"q": "sum"})
            .withColumnRenamed("sum(q)", "lfimg")
            .selectExpr(
                f"concat(l_orderkey, '/', l_suppkey, '/', {dats('fd')}) AS vbeln",
                text("l_partkey") + " AS posnr",
                padded("l_partkey", 18) + " AS matnr",
                text("lfimg") + " AS lfimg",
                "'EA' AS meins",
                text("1000 + (l_partkey + l_orderkey % 2) % 4") + " AS werks",
                "concat(l_orderkey, '/', l_suppkey) AS vgbel",
                text("l_partkey") + " AS vgpos",
                "'0' AS netwr",
                "'101' AS bwart",
                f"{dats('fd')} AS mbdat",
            )
        )

    def vbup(self) -> DataFrame:
        """Item status; every 17th vendor's deliveries have none."""
        return (
            self.announced.where("l_suppkey % 17 <> 0")
            .select("l_orderkey", "l_suppkey", "l_partkey", "fd")
            .distinct()
            .selectExpr(
                f"concat(l_orderkey, '/', l_suppkey, '/', {dats('fd')}) AS vbeln",
                text("l_partkey") + " AS posnr",
                f"CASE WHEN fd < {self.today} AND l_suppkey % 10 < 8 THEN 'C'"
                " WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS wbstk",
            )
        )
