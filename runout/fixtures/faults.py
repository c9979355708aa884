"""Faults for the checks to find: a marked part of the rows repeated, blanked or changed.

The derived extracts are clean, so a check that never finds anything would pass on them. The registered
check queries run over frames in which the rows whose leading number ends in 3 are spoilt.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runout.operators import integrity, quality


def number(column: str) -> Column:
    """The first number in a column's text; NULL without one."""
    return F.regexp_extract(F.col(column).cast("string"), "([0-9]+)", 1).try_cast("bigint")


def marked(column: str) -> Column:
    return F.coalesce(number(column) % 10 == 3, F.lit(False))


def repeated(df: DataFrame, by: str) -> DataFrame:
    """Marked rows twice, from one pass over the rows."""
    times = F.when(marked(by), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.select("*", F.explode(times).alias("__time")).drop("__time")


def changed(df: DataFrame, column: str, by: str, value: Column | str | None = None) -> DataFrame:
    """``column`` set to a value, NULL if none is given, in the marked rows."""
    kind = df.schema[column].dataType
    spoilt = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.when(marked(by), spoilt.cast(kind)).otherwise(F.col(column)))


def outside(by: str) -> Column:
    """Three values that no list accepts."""
    return F.concat(F.lit("Z"), (number(by) % 3).cast("string"))


class Spoilt(Mapping):
    """Extracts with some columns changed: {table: [(column, by, value), ...]}."""

    def __init__(self, extracts: Mapping[str, DataFrame], faults: Mapping[str, list]):
        self.extracts, self.faults = extracts, faults

    def __getitem__(self, table: str) -> DataFrame:
        df = self.extracts[table]
        for column, by, value in self.faults.get(table, []):
            df = changed(df, column, by, value)
        return df

    def __iter__(self):
        return iter(self.extracts)

    def __len__(self) -> int:
        return len(self.extracts)


# what each extract check is given to find: wrong days, missing keys, other constants, odd quantities
DATES = {
    "VBAK": [("erdat", "vbeln", "2000-01-03")],
    "LIKP": [
        ("erdat", "vbeln", "19991301"),
        ("wadat", "vbeln", "20000230"),
        ("wadat_ist", "vbeln", "today"),
    ],
    "EKKO": [("bedat", "ebeln", "1999")],
    "EKET": [("eindt", "ebeln", "00000000")],
    "VBBE": [("mbdat", "vbeln", "2000/1/3")],
    "RESB": [("bddat", "rsnum", "03012000x")],
    "MARA": [("ersda", "matnr", "-")],
}
KEYS = {table: [(key[0], key[0], None)] for table, key in integrity.PRIMARY_KEYS.items()}
CONSTANTS = {
    "VBAK": [("mandt", "vbeln", "200")],
    "EKKO": [("mandt", "ebeln", None)],
    "MARA": [("mandt", "matnr", "10")],
    "LIKP": [("lfart", "vbeln", "LF")],
}
RECEIVED = {"EKET": [("wemng", "ebeln", "1000")]}
ARRIVED = {"VBUP": [("wbstk", "vbeln", "C")]}
NOT_OPEN = {"VBBE": [("omeng", "vbeln", "0"), ("omeng", "posnr", None)]}


def repeated_tables(tables: Mapping[str, DataFrame], keys: Mapping[str, str | list[str]]):
    first = {t: k if isinstance(k, str) else k[0] for t, k in keys.items()}
    return {t: repeated(tables[t], first[t]) for t in keys}


def blanked_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    out = {}
    for table, columns in quality.NOT_NULL.items():
        df = tables[table]
        for column in columns:
            df = changed(df, column, column)
        out[table] = df
    return out


# the id that decides which rows get a value outside the list
ACCEPTED_BY = {
    "stg_marc": "marc_id",
    "stg_vbup": "document_item",
    "int_inbound_deliveries_asn": "marc_id",
    "mart_shortage_report": "marc_id",
}


def unaccepted_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        t: changed(tables[t], column, ACCEPTED_BY[t], outside(ACCEPTED_BY[t]))
        for t, column in quality.ACCEPTED_VALUES
    }
