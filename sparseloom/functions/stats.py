"""Checksums, distributions and displays of vertex results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(state: DataFrame, column: str, unreached: float) -> DataFrame:
    """One row: the sum of whole parts, the exact sum and the number of states that are not ``unreached``."""
    kept = state.filter(F.col(column) != F.lit(unreached))
    return kept.agg(F.coalesce(F.sum(F.floor(column)), F.lit(0)).cast("long").alias("checksum"), F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0)).alias("exact_sum"), F.count(F.lit(1)).alias("reachable"))


def histogram(state: DataFrame, column: str) -> DataFrame:
    return state.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("vertices"))


def value_stats(state: DataFrame, column: str) -> DataFrame:
    """One row: sum, mean, deviation (population), mode, skew by the mode, largest value and its vertex.

    Of equally frequent values the mode is the least; of equal largest values the least vertex is named.
    The mode is taken over the histogram, which is as small as there are values.
    """
    x = F.col(column).cast("double")
    main = state.agg(F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(F.struct(F.col(column).alias("v"), (-F.col("vid")).alias("u"))).alias("top"))
    mode = histogram(state, column).agg(F.max(F.struct("vertices", (-F.col("value")).alias("v"))).alias("m"))
    mode_value = (-F.col("m.v")).cast("double")
    return main.crossJoin(mode).select(  # one row each
        "sum", "mean", "std", mode_value.alias("mode"), F.when(F.col("std") > 0, (F.col("mean") - mode_value) / F.col("std")).alias("skew"), F.col("top.v").cast("double").alias("max_value"), (-F.col("top.u")).alias("max_vid")
    )


def display(state: DataFrame, count: int = 31) -> DataFrame:
    return state.orderBy("vid").limit(count)


def _or_inf(column: str, unreached: int) -> Column:
    return F.when(F.col(column) == unreached, "INF").otherwise(F.col(column).cast("string"))


def printed(state: DataFrame, kind: str, unreached: int = 2147483647) -> DataFrame:
    """(vid, text): each state in words."""
    forms = {
        "degree": lambda: F.format_string("Degree=%d", "degree"),
        "pagerank": lambda: F.format_string("Rank=%.6f,Degree=%d", "rank", "degree"),
        "bfs": lambda: F.format_string("Parent=%d,Hops=%s", F.col("parent"), _or_inf("hops", unreached)),
        "sssp": lambda: F.format_string("Distance=%s", _or_inf("distance", unreached)),
        "components": lambda: F.format_string("Label=%d", "label"),
    }
    return state.select("vid", forms[kind]().alias("text"))
