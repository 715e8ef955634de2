"""Degree, PageRank, breadth-first search, shortest paths and connected components."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparseloom.operators.ingest import build_graph
from sparseloom.operators.stars import star_components
from sparseloom.plans.graph import INF, Graph
from sparseloom.plans.program import CHECK, Dealt, Metrics, VertexProgram, deal, run
from sparseloom.plans.storage import drop_spooled, spool

ALPHA, TOLERANCE = 0.15, 1e-5


def degree(graph: Graph, by: str = "src", weighted: bool = False) -> DataFrame:
    """(vid, degree): edges with the vertex as ``by``, parallel ones each; with ``weighted``, their weights' sum."""
    graph = graph.checked()
    amount = F.sum("weight") if weighted else F.count(F.lit(1))
    counts = graph.edges.groupBy(F.col(by).alias("vid")).agg(amount.alias("degree"))
    return graph.vertices().join(counts, "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def pagerank_seed(graph: Graph, mute_zero_indegree: bool) -> DataFrame:
    """(vid, degree): the degree that a vertex divides its rank by; 0 sends nothing."""
    degrees = degree(graph)
    if not mute_zero_indegree:
        return degrees
    reached = graph.edges.select(F.col("dst").alias("vid")).distinct().withColumn("_in", F.lit(True))
    return degrees.join(reached, "vid", "left").select("vid", F.when(F.col("_in"), F.col("degree")).otherwise(0).alias("degree"))


def pagerank_program(weighted: bool = False) -> VertexProgram:
    def new_rank(total: Column) -> Column:
        return F.lit(ALPHA) + F.lit(1 - ALPHA) * F.coalesce(total, F.lit(0.0))

    return VertexProgram(
        name="pagerank",
        initial={"degree": F.coalesce("degree", F.lit(0)).cast("long"), "rank": F.lit(ALPHA)},
        message=F.when(F.col("degree") > 0, F.col("rank") / F.col("degree")).otherwise(0.0),
        edge_op=(lambda m, w: m * w) if weighted else (lambda m, w: m),
        combine="sum",
        apply=lambda total, i: {"rank": new_rank(total)},
        changed=lambda total, i: F.abs(new_rank(total) - F.col("rank")) > TOLERANCE,
        stationary=True,
    )


def pagerank(graph: Graph, iterations: int = 0, *, mute_zero_indegree: bool = True, weighted: bool = False, split: bool = True) -> tuple[DataFrame, Metrics]:
    """(vid, degree, rank), not normalised, without redistribution from dangling vertices.

    ``mute_zero_indegree``: vertices without in-edges send nothing, which is the default
    here; False is the textbook's. ``iterations`` 0: until no rank moves by more than
    1e-5. ``split`` runs a fixed count over the edges that matter only (see split_pagerank).
    """
    graph = graph.checked()
    if iterations and split:
        return split_pagerank(graph, iterations, mute_zero_indegree, weighted)
    used = graph if weighted else graph.unweighted()
    return run(used, pagerank_program(weighted), iterations, pagerank_seed(graph, mute_zero_indegree))


def split_pagerank(graph: Graph, iterations: int, mute_zero_indegree: bool, weighted: bool) -> tuple[DataFrame, Metrics]:
    """A fixed count of supersteps with computation filtering.

    Ranks of vertices that send nothing (dangling, or muted) matter only at the end, and messages of
    vertices without in-edges never change. So the loop runs over the senders that have
    in-edges; what the others send is summed once; and the last superstep reaches everyone.
    Parallel edges are folded into a multiplicity (or summed weight) first.
    """
    began = time.perf_counter()
    metrics = Metrics(iterations, ingress_seconds=graph.ingress_seconds)
    amount = F.sum("weight") if weighted else F.count(F.lit(1))
    edges = graph.edges.groupBy("src", "dst").agg(amount.cast("double").alias("_times"))
    out = graph.edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
    reached = graph.edges.select(F.col("dst").alias("vid")).distinct()
    moving = out.join(reached, "vid", "left_semi")
    shares = moving.select(F.col("vid").alias("src"), "degree")
    inner = moving.select(F.col("vid").alias("dst"), F.lit(True).alias("_inner"))
    # Shares of rank per edge, dealt by source once; the loop's messages come to them.
    live = deal(edges.join(shares, "src").join(inner, "dst", "left").select("src", "dst", (F.col("_times") / F.col("degree")).alias("_share"), F.coalesce("_inner", F.lit(False)).alias("_inner")))
    loop = Dealt(live.edges.filter("_inner"), live.parts)
    still = None
    if not mute_zero_indegree:
        first = out.join(reached, "vid", "left_anti").select(F.col("vid").alias("src"), "degree")
        still = edges.join(first, "src").groupBy(F.col("dst").alias("vid")).agg(F.sum(F.col("_times") / F.col("degree") * ALPHA).alias("_still"))
    state = moving.select("vid", F.lit(ALPHA).alias("rank"))
    if still is not None:
        state = state.join(still, "vid", "left")
    written = None
    if iterations > 1:
        state = written = spool(state, "pagerank")
    fixed = F.coalesce("_still", F.lit(0.0)) if still is not None else F.lit(0.0)
    kept = ["_still"] if still is not None else []

    def moved(over: Dealt, ranks: DataFrame) -> DataFrame:
        return over.joined(ranks.select(F.col("vid").alias("src"), "rank")).groupBy(F.col("dst").alias("vid")).agg(F.sum(F.col("rank") * F.col("_share")).alias("_sum"))

    def rank(extra: Column) -> Column:
        return (F.lit(ALPHA) + F.lit(1 - ALPHA) * (F.coalesce("_sum", F.lit(0.0)) + extra)).alias("rank")

    metrics.initial_seconds = time.perf_counter() - began
    try:
        for i in range(1, iterations):
            stepped = time.perf_counter()
            state = state.join(moved(loop, state), "vid", "left").select("vid", rank(fixed), *kept)
            if i % CHECK == 0:
                state = spool(state, "pagerank")
                drop_spooled(written)
                written = state
            metrics.step_seconds.append(time.perf_counter() - stepped)
        stepped = time.perf_counter()
        final = graph.vertices().join(moved(live, state), "vid", "left")
        if still is not None:
            final = final.join(still, "vid", "left")
        final = spool(final.join(pagerank_seed(graph, mute_zero_indegree), "vid").select("vid", "degree", rank(fixed)), "pagerank")
        metrics.step_seconds.append(time.perf_counter() - stepped)
        return final, metrics
    finally:
        live.release()
        if written is not None:
            drop_spooled(written)
        metrics.execute_seconds = time.perf_counter() - began


def bfs(graph: Graph, root: int = 0) -> tuple[DataFrame, Metrics]:
    """(vid, parent, hops) over the undirected graph; a parent is the least neighbour one level up.

    Unreached: hops INF and parent 0.
    """
    unseen = F.col("hops").isNull()
    program = VertexProgram(
        name="bfs",
        initial={"parent": F.when(F.col("vid") == root, F.lit(root)).otherwise(F.lit(0)).cast("long"), "hops": F.when(F.col("vid") == root, F.lit(0)).cast("long")},
        active=F.col("vid") == root,
        message=F.col("vid"),
        combine="min",
        apply=lambda total, i: {"parent": F.when(unseen & total.isNotNull(), total).otherwise(F.col("parent")), "hops": F.when(unseen & total.isNotNull(), F.lit(i + 1).cast("long")).otherwise(F.col("hops"))},
        changed=lambda total, i: unseen & total.isNotNull(),
    )
    used = build_graph(graph.unweighted().edges, graph.num_vertices, self_loops=False, directed=False, parallel_edges=False)
    found, metrics = run(replace(used, ingress_seconds=graph.ingress_seconds), program)
    return found.withColumn("hops", F.coalesce("hops", F.lit(INF).cast("long"))), metrics


def sssp(graph: Graph, root: int = 0, unit: bool = False) -> tuple[DataFrame, Metrics]:
    """(vid, distance) along edge directions; unreached: INF. ``unit`` counts edges instead of weights."""
    weighted = graph.weighted and not unit
    nearer = lambda total: total.isNotNull() & (F.col("distance").isNull() | (total < F.col("distance")))
    program = VertexProgram(
        name="sssp",
        initial={"distance": F.when(F.col("vid") == root, F.lit(0)).cast("long")},
        active=F.col("vid") == root,
        message=F.col("distance"),
        edge_op=(lambda m, w: m + w) if weighted else (lambda m, w: m + 1),
        combine="min",
        apply=lambda total, i: {"distance": F.when(nearer(total), total).otherwise(F.col("distance"))},
        changed=lambda total, i: nearer(total),
    )
    used = build_graph(graph.edges if weighted else graph.unweighted().edges, graph.num_vertices, self_loops=False, parallel_edges=False)
    found, metrics = run(replace(used, ingress_seconds=graph.ingress_seconds), program)
    return found.withColumn("distance", F.coalesce("distance", F.lit(INF).cast("long"))), metrics


def connected_components(graph: Graph, method: str = "stars") -> tuple[DataFrame, Metrics]:
    """(vid, label): the least id that is connected with the vertex, whatever the direction.

    ``propagate`` sends labels to neighbours until none changes, one hop a superstep; ``stars``
    reaches the same labels in a few rounds, however long the paths.
    """
    if method == "propagate":
        program = VertexProgram(
            name="components",
            initial={"label": F.col("vid")},
            message=F.col("label"),
            combine="min",
            apply=lambda total, i: {"label": F.least("label", total)},
            changed=lambda total, i: total < F.col("label"),
        )
        used = build_graph(graph.unweighted().edges, graph.num_vertices, directed=False, parallel_edges=False)
        return run(replace(used, ingress_seconds=graph.ingress_seconds), program)
    began = time.perf_counter()
    roots, rounds = star_components(graph.checked().edges)
    found = graph.vertices().join(roots, "vid", "left").select("vid", F.coalesce("root", "vid").alias("label"))
    return found, Metrics(rounds, time.perf_counter() - began, ingress_seconds=graph.ingress_seconds)
