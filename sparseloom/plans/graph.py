"""The data model: edges and a vertex universe.

A graph is an edge frame (src LONG, dst LONG[, weight LONG]) and ``num_vertices``; its vertices
are 0..num_vertices, both included, so vertices without edges have state as well.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for "not reached" in results.
INF = 2147483647

EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
WEIGHTED_EDGE = T.StructType([*EDGE.fields, T.StructField("weight", T.LongType())])


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    num_vertices: int
    #: Edge records before any were dropped; None where nobody counted.
    records_read: int | None = None
    #: Seconds that the load took; None where none was timed.
    ingress_seconds: float | None = None
    #: Whether ids outside the universe make a run fail already.
    ids_checked: bool = False

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def vertices(self) -> DataFrame:
        return self.spark.range(0, self.num_vertices + 1).withColumnRenamed("id", "vid")

    def unweighted(self) -> Graph:
        return replace(self, edges=self.edges.select("src", "dst"))

    def checked(self) -> Graph:
        return self if self.ids_checked else replace(self, edges=checked_ids(self.edges, self.num_vertices), ids_checked=True)

    def transposed(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def edges_kept(self) -> int:
        return self.edges.count()


def checked_ids(edges: DataFrame, num_vertices: int) -> DataFrame:
    """``edges``, which fail at run time on an id outside 0..num_vertices."""
    inside = F.col("src").between(0, num_vertices) & F.col("dst").between(0, num_vertices)
    message = F.concat(F.lit("edge outside the vertices: "), F.col("src").cast("string"), F.lit(" "), F.col("dst").cast("string"))
    rest = [c for c in edges.columns if c != "src"]
    return edges.select(F.when(F.coalesce(inside, F.lit(False)), F.col("src")).otherwise(F.raise_error(F.coalesce(message, F.lit("edge with a null id")))).cast("long").alias("src"), *rest)
