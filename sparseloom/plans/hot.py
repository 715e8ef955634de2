"""Joins with tables that hold one row for each key, where a few keys may have most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key that are never too many for one task.
LEAST = 256


def hot_limit(spark: SparkSession, rows: int) -> int:
    """Rows of one key from which on it counts as hot: over twice a partition's share of ``rows``."""
    return max(LEAST, 2 * rows // max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def join_hot(rows: DataFrame, by_key: DataFrame, on: str, count: str, limit: int) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row for each value of ``on`` and in ``count`` how many of ``rows`` have it.

    Keys of more than ``limit`` rows are broadcast to where their rows lie; the others are
    joined as usual. With hot_limit() of all rows, there are half as many hot keys as shuffle partitions at
    most, whatever the size of the data.
    """
    hot = F.broadcast(by_key.filter(F.col(count) > limit))
    rest = rows.join(hot.select(on), on, "left_anti").join(by_key.filter(F.col(count) <= limit), on)
    return rows.join(hot, on).unionByName(rest)
