"""Vertex programs: iterated sparse matrix by vector products over a semiring.

A program names its state as Column expressions. In a superstep the active vertices' messages
join the edges by source, an edge operation is applied, messages are combined by
destination, and new states are applied:

    messages = state.filter(active).select(vid, message)
    sums     = edges.join(messages, src).groupBy(dst).agg(combine(edge_op))
    state    = state.left_join(sums).select(apply)

Edges are dealt by source, sorted and cached once, in as many partitions as shuffles have: no
superstep exchanges them again, only messages come to them. A source with more than SPLIT edges has
them cut into parts, and its message goes to each part, so no task holds all edges of a hub.

A stationary program sends from all vertices and applies to all. Any other is run by its frontier: the
state is dealt by vertex and cached once in CHECK supersteps, a superstep touches only vertices
that got a message, and only what changed there is written.

Everything stays in Catalyst: the combiner is a built-in aggregate with a map-side part, and small
frontiers are broadcast by the optimizer's own size check (AQE), large ones shuffle. Written states
bound the plan and survive lost executors.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.plans.graph import Graph
from sparseloom.plans.storage import drop_spooled, spool, spool_counted

#: Supersteps between two written states.
CHECK = 5
#: Edges of one source that are kept together.
SPLIT = 1_000_000

COMBINERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class VertexProgram:
    """The user's contract; every hook gives Columns.

    initial: state columns from ``vid``, and from ``seed`` columns where run() gets a seed frame.
    active: which vertices send in the first superstep (stationary programs: all, always).
    message: from state to message. edge_op: (message, weight or None) to what reaches the destination.
    combine: sum, min, max or count. apply: (combined or null, superstep) to new state columns.
    changed: (combined or null, superstep) to whether the vertex is active next.
    stationary: whether all vertices send and are applied to in each superstep. If not, a vertex that
    gets no message keeps its state and is not active.
    """

    name: str
    initial: Mapping[str, Column]
    message: Column
    combine: str
    apply: Callable[[Column, int], Mapping[str, Column]]
    changed: Callable[[Column, int], Column]
    active: Column = field(default_factory=lambda: F.lit(True))
    edge_op: Callable[[Column, Column | None], Column] = lambda message, weight: message
    stationary: bool = False


@dataclass
class Metrics:
    """Seconds of a run: its preparation, each superstep, all of it; and of the graph's load, where one is known."""

    iterations: int = 0
    execute_seconds: float = 0.0
    initial_seconds: float = 0.0
    step_seconds: list[float] = field(default_factory=list)
    ingress_seconds: float | None = None

    @property
    def end_to_end_seconds(self) -> float:
        return (self.ingress_seconds or 0.0) + self.execute_seconds

    def rows(self) -> list[tuple[str, float, float, float]]:
        """(phase, seconds, mean, deviation) of the phases."""
        phases = {"ingress": [self.ingress_seconds or 0.0], "initial": [self.initial_seconds], "superstep": self.step_seconds, "execute": [self.execute_seconds], "end_to_end": [self.end_to_end_seconds]}
        return [(name, sum(x), statistics.fmean(x) if x else 0.0, statistics.pstdev(x) if x else 0.0) for name, x in phases.items()]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "phase string, seconds double, mean double, deviation double")


@dataclass
class Dealt:
    """Edges by source (and part), cached; parts: the sources that are cut, (src, _parts), or None."""

    edges: DataFrame
    parts: DataFrame | None

    def joined(self, messages: DataFrame) -> DataFrame:
        """Edges with the columns of ``messages`` (src, ...)."""
        if self.parts is None:
            return self.edges.join(messages, "src")
        # At most one row for each SPLIT edges: the optimizer's size check decides on a broadcast.
        cut = messages.join(self.parts, "src", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))).drop("_parts")
        return self.edges.join(cut, ["src", "_part"])

    def release(self) -> None:
        self.edges.unpersist()
        if self.parts is not None:
            drop_spooled(self.parts)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys``, sorted and cached, laid out as a join's shuffle would."""
    n = partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)


def deal(edges: DataFrame, split: int | None = None) -> Dealt:
    split = split or SPLIT
    by_source = dealt_by(edges, "src")
    # Edges lie by source already, so counting them exchanges nothing.
    large = by_source.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > split)
    parts = spool(large.select("src", F.ceil(F.col("_n") / split).cast("long").alias("_parts")), "hubs")
    if parts.isEmpty():
        drop_spooled(parts)
        return Dealt(by_source, None)
    part = F.pmod(F.xxhash64("dst"), F.coalesce("_parts", F.lit(1).cast("long")))
    cut = dealt_by(by_source.join(parts, "src", "left").withColumn("_part", part).drop("_parts"), "src", "_part")
    cut.count()  # cached before the first layout goes
    by_source.unpersist()
    return Dealt(cut, parts)


def run(graph: Graph, program: VertexProgram, num_iterations: int = 0, seed: DataFrame | None = None, order: str = "row") -> tuple[DataFrame, Metrics]:
    """(vid and state columns, metrics); ``num_iterations`` 0 means until no vertex changes.

    ``order``: messages go from src to dst by "row", and from dst to src by "col", on the same graph.

    The count of supersteps includes the last one, which changes nothing.
    """
    began = time.perf_counter()
    if order not in ("row", "col"):
        raise ValueError(f"unknown order {order!r}")
    graph = graph.checked() if order == "row" else graph.checked().transposed()
    metrics = Metrics(ingress_seconds=graph.ingress_seconds)
    start = graph.vertices() if seed is None else graph.vertices().join(seed, "vid", "left")
    state = start.select("vid", *[e.alias(c) for c, e in program.initial.items()], (F.lit(True) if program.stationary else program.active).alias("_active"))
    edges = deal(graph.edges if graph.weighted else graph.edges.select("src", "dst"))
    metrics.initial_seconds = time.perf_counter() - began
    try:
        loop = all_vertices if program.stationary else by_frontier
        found = loop(edges, graph.weighted, state, program, num_iterations, metrics)
    finally:
        edges.release()
    metrics.iterations = len(metrics.step_seconds)
    metrics.execute_seconds = time.perf_counter() - began
    return found.select("vid", *program.initial), metrics


def summed(edges: Dealt, weighted: bool, senders: DataFrame, program: VertexProgram) -> DataFrame:
    """(vid, _sum): messages combined by destination."""
    messages = senders.select(F.col("vid").alias("src"), program.message.alias("_message"))
    sent = program.edge_op(F.col("_message"), F.col("weight") if weighted else None)
    return edges.joined(messages).groupBy(F.col("dst").alias("vid")).agg(COMBINERS[program.combine](sent).alias("_sum"))


def applied(found: DataFrame, program: VertexProgram, step: int) -> DataFrame:
    """New states and activity of ``found`` (vid, state columns, _sum)."""
    total = F.col("_sum")
    new = program.apply(total, step)
    changed = F.coalesce(program.changed(total, step), F.lit(False))
    return found.select("vid", *[new.get(c, F.col(c)).alias(c) for c in program.initial], changed.alias("_active"))


def all_vertices(edges: Dealt, weighted: bool, state: DataFrame, program: VertexProgram, num_iterations: int, metrics: Metrics) -> DataFrame:
    written = None
    while True:
        stepped, step = time.perf_counter(), len(metrics.step_seconds)
        state = applied(state.join(summed(edges, weighted, state, program), "vid", "left"), program, step)
        last = step + 1 == num_iterations
        if last or not num_iterations or (step + 1) % CHECK == 0:
            state, seen = spool_counted(state, program.name, active=F.count_if("_active"))
            if written is not None:
                drop_spooled(written)
            written = state
        done = last or not num_iterations and not seen["active"]
        metrics.step_seconds.append(time.perf_counter() - stepped)
        if done:
            return state


def by_frontier(edges: Dealt, weighted: bool, state: DataFrame, program: VertexProgram, num_iterations: int, metrics: Metrics) -> DataFrame:
    names = list(program.initial)
    written = spool(state, program.name)
    base, senders = dealt_by(written.select("vid", *names), "vid"), written.filter("_active")
    deltas: list[DataFrame] = []
    merged: list[DataFrame] = []  # the last delta of those that ``base`` holds

    def latest() -> DataFrame:
        """(vid, _now): the last state of the vertices that changed since ``base``."""
        each = [d.select("vid", F.struct(*names).alias("_now"), F.lit(i).alias("_step")) for i, d in enumerate(deltas)]
        return reduce(DataFrame.unionByName, each).groupBy("vid").agg(F.max_by("_now", "_step").alias("_now"))

    def current(at: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        """``at`` (vid, state columns, more) with what the deltas changed."""
        if not deltas:
            return at
        kept = [F.when(F.col("_now").isNotNull(), F.col("_now")[c]).otherwise(F.col(c)).alias(c) for c in names]
        return at.join(latest(), "vid", "left").select("vid", *kept, *more)

    try:
        while True:
            stepped, step = time.perf_counter(), len(metrics.step_seconds)
            touched = current(base.join(summed(edges, weighted, senders, program), "vid"), ["_sum"])
            new, active = program.apply(F.col("_sum"), step), F.coalesce(program.changed(F.col("_sum"), step), F.lit(False))
            # What differs is written, and nothing else.
            differs = reduce(Column.__or__, [~new[c].eqNullSafe(F.col(c)) for c in names if c in new], active)
            rows = touched.filter(differs).select("vid", *[new.get(c, F.col(c)).alias(c) for c in names], active.alias("_active"))
            delta, seen = spool_counted(rows, program.name, active=F.count_if("_active"))
            deltas.append(delta)
            if merged:  # what sent in this superstep
                drop_spooled(merged.pop())
            senders = delta.filter("_active")
            done = step + 1 == num_iterations or not seen["active"]
            if done or len(deltas) == CHECK:
                whole = spool(current(base), program.name)
                base.unpersist()
                for d in [written, *deltas[:-1]]:
                    drop_spooled(d)
                merged, deltas, written = [delta], [], whole
                if not done:
                    base = dealt_by(written, "vid")
            metrics.step_seconds.append(time.perf_counter() - stepped)
            if done:
                return written
    finally:
        base.unpersist()
        for d in merged:
            drop_spooled(d)
