"""Connected components by alternating large and small stars (Kiveris et al. 2014).

Rounds grow with the logarithm of the vertices, however long the paths are. Each round is written to
the shared folder, as are its parts, so that none is computed twice. A star's centre may have a great part of all edges: such centres are broadcast to
their edges, so no task holds one star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparseloom.plans.hot import hot_limit, join_hot
from sparseloom.plans.storage import drop_spooled, spool, spool_counted


def star_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """((vid, root), rounds) for all ends of ``edges`` (src, dst), self-loops left out, that are not
    their own root; root is the least vertex of the component."""
    spark = edges.sparkSession
    now, seen = spool_counted(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "stars", rows=F.count(F.lit(1)))
    size, mark, rounds = seen["rows"], None, 0
    while True:
        rounds += 1
        limit = hot_limit(spark, 2 * size)
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = spool(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        # Large star: larger neighbours go to the least of a vertex and its neighbours.
        large = spool(join_hot(both.filter("dst > src"), least, "src", "n", limit).select(F.col("dst").alias("src"), F.col("m").alias("dst")), "stars")
        # Small star: all smaller neighbours and the vertex go to the least of them.
        low = spool(large.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        small = join_hot(large, low, "src", "n", limit).filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        made = small.unionByName(low.select("src", F.col("m").alias("dst"))).distinct()
        after, seen = spool_counted(made, "stars", rows=F.count(F.lit(1)), sign=F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")))
        for table in (least, large, low):
            drop_spooled(table)
        drop_spooled(now)
        now, size = after, seen["rows"]
        if seen == mark:
            return now.select(F.col("src").alias("vid"), F.col("dst").alias("root")), rounds
        mark = seen
