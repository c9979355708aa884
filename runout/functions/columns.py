"""Column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QTY = T.DecimalType(10, 2)
OPEN_QTY = T.DecimalType(18, 4)
SHARE = T.DecimalType(38, 18)
ID_SEPARATOR = "-"


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def parse_date(name: str | Column) -> Column:
    """``YYYYMMDD`` text to a date; anything else is NULL (and counted by ``date_format``)."""
    return F.try_to_date(col(name), "yyyyMMdd")


def joined_id(left: str | Column, right: str | Column) -> Column:
    """Two id parts with a dash between; NULL as soon as one part is NULL."""
    return F.concat(col(left), F.lit(ID_SEPARATOR), col(right))


def whole(value: str | Column) -> Column:
    """Nearest integer, halves away from zero (a plain cast would truncate)."""
    return F.round(col(value)).cast("int")


def zero_if_null(value: str | Column) -> Column:
    return F.coalesce(col(value), F.lit(0))


def sum_where(condition: Column, value: str | Column) -> Column:
    """Sum over the rows that meet a condition, 0 when there are none."""
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the fields of a schema, by name and with casts."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
