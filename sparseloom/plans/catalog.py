"""Registered queries and the SQL that must give the same rows.

Ranks and means are rounded, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions import stats
from sparseloom.operators import algorithms as alg
from sparseloom.operators import apps, classify, ingest
from sparseloom.plans.graph import INF, Graph
from sparseloom.plans.program import VertexProgram, run
from sparseloom.plans.storage import new_path
from sparseloom.sources import edges as io
from sparseloom.sources.fixtures import EDGE_SQL, edges, graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def from_edges(name: str, of: str, make: Callable[[DataFrame], DataFrame], body: str) -> None:
    register(name, lambda spark, d: make(edges(spark, d, of)), f"WITH e AS ({EDGE_SQL[of]}){'' if body.startswith(',') else ' '}{body}")


def from_graph(name: str, of: str, make: Callable[[Graph], DataFrame], body: str | None) -> None:
    register(name, lambda spark, d: make(graph(spark, d, of)), body and f"WITH RECURSIVE e AS ({EDGE_SQL[of]}), v AS ({UNIVERSE}), {body}")


UNIVERSE = "SELECT range AS vid FROM range(0, (SELECT max(greatest(src, dst)) FROM e) + 1)"
BOTH_WAYS = "u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst))"


def sixth(column: str | Column) -> Column:
    return F.round(column, 6)


# Loading.
from_edges("edges_no_self_loops", "part_supp", ingest.drop_self_loops, "SELECT src, dst, weight FROM e WHERE src <> dst")
from_edges("edges_transposed", "user_next", ingest.transpose, "SELECT dst AS src, src AS dst, weight FROM e")
from_edges("edges_acyclic", "user_next", ingest.orient_acyclic, "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM e")
from_edges("edges_symmetric", "user_next", ingest.symmetrise, "SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e")
from_edges("edges_dedup", "part_supp", lambda e: ingest.drop_parallel(e.select("src", "dst")), "SELECT DISTINCT src, dst FROM e")
from_edges("edges_dedup_min_weight", "part_supp", ingest.drop_parallel, "SELECT src, dst, min(weight) AS weight FROM e GROUP BY src, dst")
from_graph(
    "load_all_flags", "user_next",
    lambda g: ingest.build_graph(g.edges, g.num_vertices, directed=False, transposed=True, self_loops=False, acyclic=True, parallel_edges=False).edges,
    """o AS (SELECT greatest(src, dst) AS src, least(src, dst) AS dst, weight FROM e WHERE src <> dst)
    SELECT src, dst, min(weight) AS weight FROM (SELECT * FROM o UNION ALL SELECT dst, src, weight FROM o) GROUP BY src, dst""",
)
from_edges("edges_offset", "order_cust", lambda e: io.offset_ids(e, 1000), "SELECT src + 1000 AS src, dst + 1000 AS dst, weight FROM e")
from_edges("edges_drop_weight", "order_cust", io.drop_weights, "SELECT src, dst FROM e")
from_edges("edge_stats", "order_cust", io.edge_stats, "SELECT count(*) AS edges, max(greatest(src, dst)) AS max_id FROM e")
register(
    "edge_count_metrics",
    lambda spark, d: ingest.edge_metrics(edges(spark, d, "part_supp"), ingest.build_graph(edges(spark, d, "part_supp"), graph(spark, d, "part_supp").num_vertices, self_loops=False, parallel_edges=False)),
    f"""WITH e AS ({EDGE_SQL["part_supp"]}) SELECT (SELECT count(*) FROM e) AS records_read, (SELECT count(*) FROM e WHERE src = dst) AS self_loops,
    (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e WHERE src <> dst)) AS edges_kept""",
)
from_edges(
    "edges_hash_weight", "order_cust", lambda e: io.hash_weights(e, 3),
    """SELECT src, dst, (((src % 2147483647) * 48271 + (dst % 2147483647) * 69621 + 3) % 2147483647 * 16807 % 2147483647) // 16777216 + 1 AS weight FROM e""",
)


# Files: what is written comes back.
def text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "text")
    io.write_text(edges(spark, d, "order_cust"), path)
    return io.read_edges(spark, path, weighted=True)


def binary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "binary")
    io.write_binary(edges(spark, d, "order_cust"), path)
    return io.read_edges(spark, path, weighted=True)


def convert_text_to_weighted_binary(spark: SparkSession, d: str) -> DataFrame:
    text, binary = new_path(spark, "text"), new_path(spark, "binary")
    io.write_text(io.drop_weights(edges(spark, d, "order_cust")), text)
    return io.convert(spark, text, binary, target_weighted=True, offset=5)


WHOLE = f"WITH e AS ({EDGE_SQL['order_cust']}) SELECT src, dst, weight FROM e"
register("text_roundtrip", text_roundtrip, WHOLE)
register("binary_roundtrip", binary_roundtrip, WHOLE)
register("convert_text_to_weighted_binary", convert_text_to_weighted_binary, f"WITH e AS ({EDGE_SQL['order_cust']}) SELECT count(*) AS edges, max(greatest(src, dst)) + 5 AS max_id, CAST(0 AS BIGINT) AS comments, count(*) AS lines FROM e")


def convert_commented_text(spark: SparkSession, d: str) -> DataFrame:
    found, text, other = edges(spark, d, "order_cust"), new_path(spark, "text"), new_path(spark, "text")
    remarks = found.filter("src % 10 = 0").select(F.concat(F.when(F.col("src") % 20 == 0, "# ").otherwise("% "), F.col("src").cast("string")).alias("value"))
    found.select(F.concat_ws(" ", "src", "dst", "weight").alias("value")).unionByName(remarks).write.text(text)
    return io.convert(spark, text, other, source_weighted=True, target_format="text")


register(
    "convert_commented_text", convert_commented_text,
    f"WITH e AS ({EDGE_SQL['order_cust']}), c AS (SELECT count(*) AS n FROM e WHERE src % 10 = 0) SELECT count(*) AS edges, max(greatest(src, dst)) AS max_id, any_value(n) AS comments, count(*) + any_value(n) AS lines FROM e, c",
)


def from_file(spark: SparkSession, d: str, of: str, binary: bool, weighted: bool = False) -> tuple[str, int]:
    """The path of a graph that was written as a file, and its largest id."""
    found, path = graph(spark, d, of), new_path(spark, "edges")
    (io.write_binary if binary else io.write_text)(found.edges if weighted else found.edges.select("src", "dst"), path)
    return path, found.num_vertices


def loaded(binary: bool, **flags) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        path, n = from_file(spark, d, "part_supp", binary, weighted=True)
        found = ingest.load(spark, path, n, weighted=True, **flags)
        return found.edges.withColumn("records_read", F.lit(found.records_read).cast("long"))

    return query


PART_SUPP = f"WITH e AS ({EDGE_SQL['part_supp']})"
register("load_text_file", loaded(False, transposed=True), f"{PART_SUPP} SELECT dst AS src, src AS dst, weight, (SELECT count(*) FROM e) AS records_read FROM e")
register(
    "load_binary_file", loaded(True, directed=False, self_loops=False, parallel_edges=False),
    f"""{PART_SUPP} SELECT src, dst, min(weight) AS weight, (SELECT count(*) FROM e) AS records_read
    FROM (SELECT src, dst, weight FROM e WHERE src <> dst UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst) GROUP BY src, dst""",
)

# Vertex sets, classes and layout.
CLASSES = """io AS (SELECT v.vid, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM v
    LEFT JOIN (SELECT dst AS vid, count(*) AS n FROM e GROUP BY dst) i ON i.vid = v.vid LEFT JOIN (SELECT src AS vid, count(*) AS n FROM e GROUP BY src) o ON o.vid = v.vid),
    k AS (SELECT *, CASE WHEN in_degree > 0 AND out_degree > 0 THEN 'regular' WHEN in_degree > 0 THEN 'only_in' WHEN out_degree > 0 THEN 'only_out' ELSE 'isolated' END AS vclass FROM io)"""
from_edges("rows_nonempty", "order_part", lambda e: classify.nonempty_rows(Graph(e, 0)), "SELECT DISTINCT src AS vid FROM e")
from_edges("cols_nonempty", "order_part", lambda e: classify.nonempty_cols(Graph(e, 0)), "SELECT DISTINCT dst AS vid FROM e")
from_graph("vertex_class", "order_part", classify.vertex_classes, f"{CLASSES} SELECT vid, in_degree, out_degree, vclass FROM k")
from_graph("vertex_class_counts", "order_part", lambda g: classify.vertex_classes(g).groupBy("vclass").agg(F.count(F.lit(1)).alias("vertices")), f"{CLASSES} SELECT vclass, count(*) AS vertices FROM k GROUP BY vclass")
from_graph(
    "edge_block_counts", "order_part", lambda g: classify.blocked_edges(g).groupBy("src_class", "dst_class").agg(F.count(F.lit(1)).alias("edges")),
    f"{CLASSES} SELECT a.vclass AS src_class, b.vclass AS dst_class, count(*) AS edges FROM e JOIN k a ON a.vid = e.src JOIN k b ON b.vid = e.dst GROUP BY 1, 2",
)
from_graph("tile_histogram", "part_supp", lambda g: classify.tile_histogram(g, 4), "h AS (SELECT (max(greatest(src, dst)) + 4) // 4 AS h FROM e) SELECT src // h AS row_tile, dst // h AS col_tile, count(*) AS edges FROM e, h GROUP BY 1, 2")
from_edges(
    "partition_balance", "part_supp", lambda e: classify.partition_balance(e.repartitionById(8, F.pmod("src", F.lit(8)).cast("int"))).withColumn("ratio", sixth("ratio")),
    """, p AS (SELECT src % 8 AS partition, count(*) AS edges FROM e GROUP BY 1) SELECT CAST(partition AS INTEGER) AS partition, edges, round(edges / (SELECT avg(edges) FROM p), 6) AS ratio FROM p""",
)
TILES = "h AS (SELECT (max(greatest(src, dst)) + 4) // 4 AS h FROM e), t AS (SELECT src // h AS r, dst // h AS c, count(*) AS edges FROM e, h GROUP BY 1, 2)"
from_graph(
    "balance_report", "part_supp", lambda g: classify.balance_report(g, 4).withColumn("ratio", sixth("ratio")),
    f"""{TILES}, k AS (SELECT 'tile' AS kind, 4 * r + c AS part, edges, 16 AS n FROM t UNION ALL SELECT 'row', r, sum(edges), 4 FROM t GROUP BY r UNION ALL SELECT 'column', c, sum(edges), 4 FROM t GROUP BY c),
    x AS (SELECT kind, CAST(part AS BIGINT) AS part, CAST(edges AS BIGINT) AS edges, edges * n / CAST((SELECT count(*) FROM e) AS DOUBLE) AS ratio FROM k)
    SELECT kind, part, edges, round(ratio, 6) AS ratio, abs(ratio - 1) <= 0.2 AS balanced FROM x""",
)
from_graph("edges_distributed", "part_supp", lambda g: classify.distributed(g, 4), "w AS (SELECT src, dst, weight FROM e) SELECT src, dst, weight FROM w")

# Degree.
DEGREE = "d AS (SELECT v.vid, coalesce(n, 0) AS degree FROM v LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) c ON c.src = v.vid)"
from_graph("degree_out", "part_supp", alg.degree, f"{DEGREE} SELECT vid, degree FROM d")
from_graph("degree_in", "part_supp", lambda g: alg.degree(g, "dst"), "d AS (SELECT v.vid, coalesce(n, 0) AS degree FROM v LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) c ON c.dst = v.vid) SELECT vid, degree FROM d")
from_graph("degree_weighted", "part_supp", lambda g: alg.degree(g, weighted=True), "d AS (SELECT v.vid, CAST(coalesce(n, 0) AS BIGINT) AS degree FROM v LEFT JOIN (SELECT src, sum(weight) AS n FROM e GROUP BY src) c ON c.src = v.vid) SELECT vid, degree FROM d")
from_graph("degree_histogram", "part_supp", lambda g: stats.histogram(alg.degree(g), "degree"), f"{DEGREE} SELECT degree AS value, count(*) AS vertices FROM d GROUP BY degree")
from_graph("degree_checksum", "part_supp", lambda g: stats.checksum(alg.degree(g), "degree", 0), f"{DEGREE} SELECT CAST(sum(degree) AS BIGINT) AS checksum, CAST(sum(degree) AS DOUBLE) AS exact_sum, count(*) AS reachable FROM d WHERE degree <> 0")
from_graph(
    "degree_stats", "part_supp", lambda g: stats.value_stats(alg.degree(g), "degree").select(*[sixth(c).alias(c) for c in ("sum", "mean", "std", "mode", "skew", "max_value")], "max_vid"),
    f"""{DEGREE}, m AS (SELECT degree AS mode FROM d GROUP BY degree ORDER BY count(*) DESC, degree LIMIT 1), t AS (SELECT vid AS max_vid FROM d ORDER BY degree DESC, vid LIMIT 1)
    SELECT round(CAST(sum(degree) AS DOUBLE), 6) AS sum, round(avg(degree), 6) AS mean, round(stddev_pop(degree), 6) AS std, round(CAST(any_value(mode) AS DOUBLE), 6) AS mode,
    round((avg(degree) - any_value(mode)) / stddev_pop(degree), 6) AS skew, round(CAST(max(degree) AS DOUBLE), 6) AS max_value, any_value(max_vid) AS max_vid FROM d, m, t""",
)
from_graph("degree_top31", "part_supp", lambda g: stats.display(alg.degree(g)), f"{DEGREE} SELECT vid, degree FROM d ORDER BY vid LIMIT 31")
from_graph("degree_printed", "part_supp", lambda g: stats.printed(alg.degree(g), "degree"), f"{DEGREE} SELECT vid, 'Degree=' || degree AS text FROM d")


# PageRank.
def ranks_sql(steps: int, muted: bool = True, weighted: bool = False) -> str:
    degree = "CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.dst = d.vid) THEN degree ELSE 0 END" if muted else "degree"
    times = "sum(weight)" if weighted else "count(*)"
    head = f"{DEGREE}, s AS MATERIALIZED (SELECT vid, {degree} AS degree FROM d), m AS MATERIALIZED (SELECT e.src, e.dst, CAST({times} AS DOUBLE) / any_value(s.degree) AS share FROM e JOIN s ON s.vid = e.src AND s.degree > 0 GROUP BY e.src, e.dst), r0 AS MATERIALIZED (SELECT vid, CAST(0.15 AS DOUBLE) AS rank FROM s)"
    chain = "".join(
        f", r{i} AS MATERIALIZED (SELECT v.vid, 0.15 + 0.85 * coalesce(t, 0) AS rank FROM v LEFT JOIN (SELECT m.dst, sum(r.rank * m.share) AS t FROM m JOIN r{i - 1} r ON r.vid = m.src GROUP BY m.dst) x ON x.dst = v.vid)"
        for i in range(1, steps + 1)
    )
    return f"{head}{chain}, p AS (SELECT s.vid, s.degree, r.rank FROM s JOIN r{steps} r ON r.vid = s.vid)"


def ranked(g: Graph, steps: int, digits: int = 8, **options) -> DataFrame:
    return alg.pagerank(g, steps, **options)[0].select("vid", "degree", F.round("rank", digits).alias("rank"))


RANKED = "SELECT vid, degree, round(rank, 8) AS rank FROM p"
from_graph("pagerank_20", "order_part", lambda g: ranked(g, 20), f"{ranks_sql(20)} {RANKED}")
from_graph("pagerank_20_user_next", "user_next", lambda g: ranked(g, 20), f"{ranks_sql(20)} {RANKED}")
from_graph("pagerank_1", "order_part", lambda g: ranked(g, 1), f"{ranks_sql(1)} {RANKED}")
from_graph("pagerank_plain_5", "order_part", lambda g: ranked(g, 5, split=False), f"{ranks_sql(5)} {RANKED}")
from_graph("pagerank_textbook_20", "order_part", lambda g: ranked(g, 20, mute_zero_indegree=False), f"{ranks_sql(20, muted=False)} {RANKED}")
from_graph("pagerank_weighted_5", "user_next", lambda g: ranked(g, 5, 3, weighted=True), f"{ranks_sql(5, weighted=True)} SELECT vid, degree, round(rank, 3) AS rank FROM p")
# Every row carries the step's largest move, which ends the recursion.
CONVERGED = f"""{ranks_sql(0).rpartition(", p AS")[0]}, i(step, vid, rank, moved) AS (SELECT 0, vid, rank, CAST(1 AS DOUBLE) FROM r0
    UNION ALL SELECT step, vid, rank, max(abs(rank - old)) OVER () FROM (
        SELECT i.step + 1 AS step, i.vid, 0.15 + 0.85 * coalesce(t, 0) AS rank, i.rank AS old FROM i
        LEFT JOIN (SELECT m.dst, sum(j.rank * m.share) AS t FROM m JOIN i j ON j.vid = m.src GROUP BY m.dst) x ON x.dst = i.vid WHERE i.moved > 1e-5))"""
from_graph("pagerank_converged", "user_next", lambda g: ranked(g, 0), f"{CONVERGED} SELECT i.vid, s.degree, round(i.rank, 8) AS rank FROM i JOIN s ON s.vid = i.vid WHERE step = (SELECT max(step) FROM i)")
from_graph(
    "pagerank_checksum", "order_part", lambda g: stats.checksum(alg.pagerank(g, 20)[0], "rank", 0.0).withColumn("exact_sum", sixth("exact_sum")),
    f"{ranks_sql(20)} SELECT CAST(sum(floor(rank)) AS BIGINT) AS checksum, round(sum(rank), 6) AS exact_sum, count(*) AS reachable FROM p WHERE rank <> 0",
)


# Frontier programs.
def last_vertex(g: Graph) -> int:
    return g.num_vertices


# Levels as a keyed recursion: a vertex keeps the first level that reaches it.
LEVELS = f"""{BOTH_WAYS}, l(vid, hops) USING KEY (vid) AS (SELECT (SELECT max(vid) FROM v), CAST(0 AS BIGINT)
    UNION SELECT u.dst, min(l.hops + 1) FROM l JOIN u ON u.src = l.vid LEFT JOIN recurring.l AS c ON c.vid = u.dst WHERE c.vid IS NULL GROUP BY u.dst),
    q AS (SELECT u.dst AS vid, min(u.src) AS parent FROM u JOIN l a ON a.vid = u.src JOIN l z ON z.vid = u.dst WHERE a.hops = z.hops - 1 GROUP BY u.dst),
    b AS (SELECT v.vid, CASE WHEN l.hops = 0 THEN v.vid ELSE coalesce(q.parent, 0) END AS parent, coalesce(l.hops, {INF}) AS hops FROM v LEFT JOIN l ON l.vid = v.vid LEFT JOIN q ON q.vid = v.vid)"""
from_graph("bfs", "order_part", lambda g: alg.bfs(g, last_vertex(g))[0], f"{LEVELS} SELECT vid, parent, hops FROM b")
from_graph("bfs_printed", "order_part", lambda g: stats.printed(alg.bfs(g, last_vertex(g))[0], "bfs"), f"{LEVELS} SELECT vid, 'Parent=' || parent || ',Hops=' || CASE WHEN hops = {INF} THEN 'INF' ELSE CAST(hops AS VARCHAR) END AS text FROM b")
from_graph("bfs_level_counts", "order_part", lambda g: alg.bfs(g, last_vertex(g))[0].groupBy("hops").agg(F.count(F.lit(1)).alias("vertices")), f"{LEVELS} SELECT hops, count(*) AS vertices FROM b GROUP BY hops")


def distances(amount: str) -> str:
    return f"""n AS (SELECT src, dst, min({amount}) AS w FROM e WHERE src <> dst GROUP BY src, dst), l(vid, distance) USING KEY (vid) AS (SELECT (SELECT max(vid) FROM v), CAST(0 AS BIGINT)
    UNION SELECT n.dst, min(l.distance + n.w) FROM l JOIN n ON n.src = l.vid LEFT JOIN recurring.l AS c ON c.vid = n.dst GROUP BY n.dst HAVING min(l.distance + n.w) < coalesce(any_value(c.distance), {INF})),
    s AS (SELECT v.vid, coalesce(l.distance, {INF}) AS distance FROM v LEFT JOIN l ON l.vid = v.vid)"""


from_graph("sssp", "order_part", lambda g: alg.sssp(g, last_vertex(g))[0], f"{distances('weight')} SELECT vid, distance FROM s")
from_graph("sssp_unit", "order_part", lambda g: alg.sssp(g, last_vertex(g), unit=True)[0], f"{distances('CAST(1 AS BIGINT)')} SELECT vid, distance FROM s")
from_graph(
    "sssp_reachable", "order_part", lambda g: stats.checksum(alg.sssp(g, last_vertex(g))[0], "distance", INF),
    f"{distances('weight')} SELECT CAST(sum(distance) AS BIGINT) AS checksum, CAST(sum(distance) AS DOUBLE) AS exact_sum, count(*) AS reachable FROM s WHERE distance <> {INF}",
)
LABELS = f"""{BOTH_WAYS}, l(vid, label) USING KEY (vid) AS (SELECT vid, vid FROM v
    UNION SELECT u.dst, min(l.label) FROM l JOIN u ON u.src = l.vid LEFT JOIN recurring.l AS c ON c.vid = u.dst GROUP BY u.dst HAVING min(l.label) < any_value(c.label))"""
from_graph("connected_components", "order_cust", lambda g: alg.connected_components(g)[0], f"{LABELS} SELECT vid, label FROM l")
from_graph("connected_components_propagate", "order_part", lambda g: alg.connected_components(g, "propagate")[0], f"{LABELS} SELECT vid, label FROM l")
from_graph("cc_sizes", "order_part", lambda g: alg.connected_components(g)[0].groupBy("label").agg(F.count(F.lit(1)).alias("vertices")), f"{LABELS} SELECT label, count(*) AS vertices FROM l GROUP BY label")
from_graph("cc_count", "order_part", lambda g: alg.connected_components(g)[0].agg(F.count_distinct("label").alias("components")), f"{LABELS} SELECT count(DISTINCT label) AS components FROM l")


# Applications, from a file to printed states.
def app(name: str, of: str, binary: bool = True, weighted: bool = False, iterations: int = 0) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        path, n = from_file(spark, d, of, binary, weighted)
        return apps.run_app(name, spark, path, n, root=n, weighted=weighted, iterations=iterations).shown

    return query


def from_app(name: str, of: str, body: str, **options) -> None:
    register(f"app_{name}", app(name, of, **options), f"WITH RECURSIVE e AS ({EDGE_SQL[of]}), v AS ({UNIVERSE}), {body} ORDER BY vid LIMIT 31")


OR_INF = f"CASE WHEN {{0}} = {INF} THEN 'INF' ELSE CAST({{0}} AS VARCHAR) END"
from_app("degree", "part_supp", f"{DEGREE} SELECT vid, 'Degree=' || degree AS text FROM d", binary=False)
from_app("pagerank", "order_part", f"{ranks_sql(20)} SELECT vid, printf('Rank=%.6f,Degree=%d', rank, degree) AS text FROM p", iterations=20)
from_app("bfs", "order_part", f"{LEVELS} SELECT vid, 'Parent=' || parent || ',Hops=' || {OR_INF.format('hops')} AS text FROM b")
from_app("sssp", "order_part", f"{distances('weight')} SELECT vid, 'Distance=' || {OR_INF.format('distance')} AS text FROM s", binary=False, weighted=True)
from_app("components", "order_cust", f"{LABELS} SELECT vid, 'Label=' || label AS text FROM l")


def kernel(spark: SparkSession, d: str) -> DataFrame:
    return apps.kernel_report(spark, *from_file(spark, d, "order_part", True), 5).select("iterations", "operations", sixth("final_value").alias("final_value"), "bytes")


register("kernel_report", kernel, f"WITH RECURSIVE e AS ({EDGE_SQL['order_part']}), v AS ({UNIVERSE}), {ranks_sql(5)}, n AS (SELECT count(*) AS n FROM e) SELECT CAST(5 AS BIGINT) AS iterations, 5 * any_value(n) AS operations, round(sum(rank), 6) AS final_value, 16 * any_value(n) + 16 * count(*) AS bytes FROM p, n")


# A program of the user's own: each vertex's least weight of an in-edge, or by column of an out-edge.
def least_weight(g: Graph, order: str = "row") -> DataFrame:
    program = VertexProgram(
        name="least_weight",
        initial={"least": F.lit(None).cast("long")},
        message=F.lit(1),
        edge_op=lambda message, weight: weight,
        combine="min",
        apply=lambda total, i: {"least": total},
        changed=lambda total, i: F.lit(False),
        stationary=True,
    )
    return run(g, program, 1, order=order)[0]


from_graph("custom_program_min_weight", "order_part", least_weight, "w AS (SELECT dst, min(weight) AS least FROM e GROUP BY dst) SELECT v.vid, w.least FROM v LEFT JOIN w ON w.dst = v.vid")
from_graph("custom_program_by_column", "order_part", lambda g: least_weight(g, "col"), "w AS (SELECT src, min(weight) AS least FROM e GROUP BY src) SELECT v.vid, w.least FROM v LEFT JOIN w ON w.src = v.vid")
