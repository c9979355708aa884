"""Transit lanes: read the typed seed file, or build it from vendors and plants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runout.sources.schemas import LANES

# Days from a country to the plants' region, and what each plant adds.
DAYS_FROM_COUNTRY = {"DE": 3, "AT": 4, "CH": 5, "JP": 21, "CN": 28}
DAYS_TO_PLANT = {"1000": 0, "1001": 1, "1002": 2, "1003": 1}
PURCHASING_ORG = "1000"


def read_lanes(spark: SparkSession, path: str) -> DataFrame:
    """The seed file with its declared types; ids keep their leading zeros.

    Columns are taken by header name, in any case and order, and must be the declared ones. A row with
    more or fewer fields, a part file with another header, days that are no whole number: all are errors,
    the last where the days are read.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = [c.lower() for c in header]
    if sorted(names) != sorted(LANES.fieldNames()):
        raise ValueError(f"seed columns {names} are not the declared {LANES.fieldNames()}")
    kinds = {f.name: f.dataType for f in LANES}
    schema = T.StructType([T.StructField(c, kinds[n]) for c, n in zip(header, names, strict=True)])
    options = {"header": True, "mode": "FAILFAST", "enforceSchema": False, "columnPruning": False}
    return spark.read.options(**options).schema(schema).csv(path).toDF(*names).select(LANES.fieldNames())


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def lane_matrix(
    lfa1: DataFrame,
    days_from_country: dict[str, int] = DAYS_FROM_COUNTRY,
    days_to_plant: dict[str, int] = DAYS_TO_PLANT,
    purchasing_org: str = PURCHASING_ORG,
) -> DataFrame:
    """A lane from every distinct (vendor, country) to every plant; an unknown country is an error.

    The plants are unfolded from a literal on each vendor row, so nothing but the distinct vendors
    is shuffled.
    """
    plants = F.explode(F.array(*[F.lit(plant) for plant in days_to_plant]))
    base = F.coalesce(
        _lookup(days_from_country, F.col("land1")),
        F.raise_error(F.concat(F.lit("no transit days for country "), F.col("land1"))).cast("int"),
    )
    return (
        lfa1.select("lifnr", "land1")
        .distinct()
        .select(
            "lifnr",
            F.lit(purchasing_org).alias("ekorg"),
            plants.alias("werks"),
            base.alias("base"),
        )
        .select(
            "lifnr",
            "ekorg",
            "werks",
            (F.col("base") + _lookup(days_to_plant, F.col("werks"))).alias("transit_time_days"),
        )
    )
