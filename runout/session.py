"""Session settings the operators rely on.

No operator hints a broadcast. Catalyst broadcasts a side when its size estimate is under
``spark.sql.autoBroadcastJoinThreshold`` and AQE does so on the measured shuffle size, so the
same plan turns into a sort-merge join when a "small" table has grown. In between, where every shuffled
partition of a side is small, AQE builds a hash table of it instead of sorting both sides: ids are
zero-padded texts, which are dear to sort since they begin alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Whether Spark removes the shuffles of an execution as soon as this has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    # quantities and dates follow ANSI rules: overflow is an error, not NULL
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # split a hot join key even where the split costs one more exchange afterwards
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # only used if no less than the advisory size of a partition, which is 64m unless set
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For steps that are stored and read back: their shuffles are removed as soon as they are written.

    Otherwise they stay until the driver happens to collect its garbage, and those of all steps add up on disk.
    The session's own setting returns afterwards: a frame that is run twice would have to shuffle again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
