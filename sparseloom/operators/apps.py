"""The applications: an edge list's path in; states, checksum, printed states and timing out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions import stats
from sparseloom.operators import algorithms as alg
from sparseloom.operators.ingest import load
from sparseloom.plans.graph import INF, Graph
from sparseloom.plans.program import Metrics

#: Vertices that an application prints.
SHOWN = 31


@dataclass
class AppRun:
    graph: Graph
    state: DataFrame
    checksum: DataFrame
    shown: DataFrame
    metrics: Metrics


def _degree(graph: Graph, root: int, iterations: int) -> tuple[DataFrame, Metrics]:
    return alg.degree(graph), Metrics(1, ingress_seconds=graph.ingress_seconds)


#: Per application: its run, the state column of its checksum, and the value that counts as unreached.
APPS: dict[str, tuple[Callable[[Graph, int, int], tuple[DataFrame, Metrics]], str, float]] = {
    "degree": (_degree, "degree", 0),
    "pagerank": (lambda g, root, iterations: alg.pagerank(g, iterations), "rank", 0.0),
    "bfs": (lambda g, root, iterations: alg.bfs(g, root), "hops", INF),
    "sssp": (lambda g, root, iterations: alg.sssp(g, root), "distance", INF),
    "components": (lambda g, root, iterations: alg.connected_components(g), "label", INF),
}


def run_app(name: str, spark: SparkSession, path: str, num_vertices: int, *, root: int = 0, iterations: int = 0, weighted: bool = False, fmt: str | None = None) -> AppRun:
    """Load the edge list at ``path`` and run ``name`` on it. ``iterations`` 0: until nothing changes."""
    run, column, unreached = APPS[name]
    graph = load(spark, path, num_vertices, weighted=weighted, fmt=fmt)
    state, metrics = run(graph, root, iterations)
    return AppRun(graph, state, stats.checksum(state, column, unreached), stats.printed(stats.display(state, SHOWN), name), metrics)


def kernel_report(spark: SparkSession, path: str, num_vertices: int, iterations: int, fmt: str | None = None) -> DataFrame:
    """One row on PageRank as a plain iterated product: iterations, operations (edges touched), final_value
    (sum of ranks), bytes (of edges and two vectors as 64-bit numbers) and seconds."""
    graph = load(spark, path, num_vertices, fmt=fmt)
    state, metrics = alg.pagerank(graph, iterations, split=False)
    edges = graph.records_read
    return state.agg(F.sum("rank").alias("final_value")).select(
        F.lit(iterations).cast("long").alias("iterations"),
        F.lit(edges * iterations).cast("long").alias("operations"),
        "final_value",
        F.lit(16 * edges + 16 * (num_vertices + 1)).cast("long").alias("bytes"),
        F.lit(metrics.execute_seconds).alias("seconds"),
    )
