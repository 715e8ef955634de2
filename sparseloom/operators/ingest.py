"""Edge filters and projections, in the order in which a load applies them."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.plans.graph import Graph, checked_ids
from sparseloom.sources.edges import read_edges


def _rest(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c not in ("src", "dst")]


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def orient_acyclic(edges: DataFrame) -> DataFrame:
    """Every edge points to the larger id."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *_rest(edges))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *_rest(edges))


def symmetrise(edges: DataFrame) -> DataFrame:
    """All edges and their reverses; a self-loop comes twice."""
    return edges.unionByName(transpose(edges))


def drop_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst), with the least weight."""
    if "weight" in edges.columns:
        return edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return edges.distinct()


def build_graph(
    edges: DataFrame, num_vertices: int, *, directed: bool = True, transposed: bool = False, self_loops: bool = True, acyclic: bool = False, parallel_edges: bool = True, records_read: int | None = None
) -> Graph:
    """Self-loop filter, acyclic orientation, transposition, reverse edges, then parallel edges."""
    found = checked_ids(edges, num_vertices)
    if not self_loops:
        found = drop_self_loops(found)
    if acyclic:
        found = orient_acyclic(found)
    if transposed:
        found = transpose(found)
    if not directed:
        found = symmetrise(found)
    if not parallel_edges:
        found = drop_parallel(found)
    return Graph(found, num_vertices, records_read, ids_checked=True)


def load(
    spark: SparkSession, path: str, num_vertices: int, *, directed: bool = True, transposed: bool = False, self_loops: bool = True, acyclic: bool = False,
    parallel_edges: bool = True, weighted: bool = False, fmt: str | None = None,
) -> Graph:
    """The graph of an edge list, text or binary (``fmt``; None: told by its first bytes).

    Records are counted as they are read (``records_read``), and the load is timed.
    """
    began = time.perf_counter()
    found = read_edges(spark, path, fmt, weighted)
    graph = build_graph(found, num_vertices, directed=directed, transposed=transposed, self_loops=self_loops, acyclic=acyclic, parallel_edges=parallel_edges, records_read=found.count())
    return replace(graph, ingress_seconds=time.perf_counter() - began)


def edge_metrics(before: DataFrame, graph: Graph) -> DataFrame:
    """One row: records read, edges kept, self-loops among the records."""
    kept = graph.edges.agg(F.count(F.lit(1)).alias("edges_kept"))
    return before.agg(F.count(F.lit(1)).alias("records_read"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops")).crossJoin(kept)  # one row each
