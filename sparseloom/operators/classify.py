"""Vertex classes, the edge blocks they make, and how evenly edges lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparseloom.plans.graph import Graph


def nonempty_rows(graph: Graph) -> DataFrame:
    """Vertices with out-edges."""
    return graph.edges.select(F.col("src").alias("vid")).distinct()


def nonempty_cols(graph: Graph) -> DataFrame:
    """Vertices with in-edges."""
    return graph.edges.select(F.col("dst").alias("vid")).distinct()


def vertex_classes(graph: Graph) -> DataFrame:
    """(vid, in_degree, out_degree, vclass): regular, only_in (dangling), only_out (no in-edge) or isolated.

    One aggregation over both ends of the edges, one join with the universe.
    """
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    degrees = ends.groupBy("vid").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    has_in, has_out = F.col("in_degree") > 0, F.col("out_degree") > 0
    label = F.when(has_in & has_out, "regular").when(has_in, "only_in").when(has_out, "only_out").otherwise("isolated")
    zero = F.lit(0).cast("long")
    return graph.vertices().join(degrees, "vid", "left").select("vid", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree")).withColumn("vclass", label)


def blocked_edges(graph: Graph) -> DataFrame:
    """Edges with the classes of both ends."""
    classes = vertex_classes(graph).select("vid", "vclass")
    out = graph.edges.join(classes.withColumnsRenamed({"vid": "src", "vclass": "src_class"}), "src")
    return out.join(classes.withColumnsRenamed({"vid": "dst", "vclass": "dst_class"}), "dst")


def tile_histogram(graph: Graph, tiles: int) -> DataFrame:
    """Edges in each block of a tiles x tiles grid over the adjacency matrix."""
    return graph.edges.groupBy(*[c.alias(n) for n, c in tile_of(graph, tiles).items()]).agg(F.count(F.lit(1)).alias("edges"))


def tile_of(graph: Graph, tiles: int) -> dict[str, Column]:
    """The row and column of the tile in which an edge lies."""
    height = -(-(graph.num_vertices + 1) // tiles)
    return {"row_tile": F.floor(F.col("src") / height), "col_tile": F.floor(F.col("dst") / height)}


def distributed(graph: Graph, tiles: int) -> DataFrame:
    """Edges dealt by their tile over tiles x tiles partitions."""
    return graph.edges.withColumns(tile_of(graph, tiles)).repartition(tiles * tiles, "row_tile", "col_tile").drop("row_tile", "col_tile")


def balance_report(graph: Graph, tiles: int, threshold: float = 0.2) -> DataFrame:
    """(kind, part, edges, ratio, balanced): edges of each tile, tile row and tile column that has any, and
    their ratio to the mean over all of its kind, empty ones included."""
    each = tile_histogram(graph, tiles)
    mean = F.sum("edges").over(Window.partitionBy("kind")) / F.when(F.col("kind") == "tile", tiles * tiles).otherwise(tiles)  # as many rows as tiles
    kinds = [("tile", F.col("row_tile") * tiles + F.col("col_tile")), ("row", F.col("row_tile")), ("column", F.col("col_tile"))]
    parts = each.select("edges", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.cast("long").alias("part")) for k, p in kinds])).alias("p")).groupBy("p.kind", "p.part").agg(F.sum("edges").alias("edges"))
    return parts.withColumn("ratio", F.col("edges") / mean).withColumn("balanced", F.abs(F.col("ratio") - 1) <= threshold)


def partition_balance(edges: DataFrame) -> DataFrame:
    """(partition, edges, ratio to the mean): a diagnosis of the physical layout."""
    each = edges.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("edges"))
    mean = each.agg(F.avg("edges").alias("_mean"))
    return each.crossJoin(mean).select("partition", "edges", (F.col("edges") / F.col("_mean")).alias("ratio"))  # one row
