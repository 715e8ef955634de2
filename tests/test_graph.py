"""The hand-sized graph with its golden values, invariants, and files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparseloom.functions import stats
from sparseloom.operators import algorithms as alg
from sparseloom.operators import apps, classify, ingest
from sparseloom.plans import hot, program
from sparseloom.plans.graph import INF, WEIGHTED_EDGE, Graph
from sparseloom.sources import edges as io

TINY = [(1, 2, 4), (1, 3, 1), (3, 2, 2), (2, 4, 5), (4, 1, 3), (3, 3, 9), (3, 2, 7), (5, 1, 6), (4, 6, 2), (8, 9, 1)]
DEGREE = [0, 2, 1, 3, 2, 1, 0, 0, 1, 0, 0]
PARITY = [0.15, 0.428305, 0.594362, 0.463168, 0.655053, 0.15, 0.428305, 0.15, 0.15, 0.15, 0.15]
TEXTBOOK = [0.15, 0.604032, 0.728025, 0.567331, 0.768609, 0.15, 0.476532, 0.15, 0.15, 0.2775, 0.15]
HOPS = [INF, 0, 1, 1, 1, 1, 2, INF, INF, INF, INF]
PARENT = [0, 1, 1, 1, 1, 1, 4, 0, 0, 0, 0]
WEIGHTED = [INF, 0, 3, 1, 8, INF, 10, INF, INF, INF, INF]
UNIT = [INF, 0, 1, 1, 2, INF, 3, INF, INF, INF, INF]
LABEL = [0, 1, 1, 1, 1, 1, 1, 7, 8, 8, 10]


@pytest.fixture(scope="module")
def tiny(spark):
    return Graph(spark.createDataFrame(TINY, WEIGHTED_EDGE), 10)


def column(df, name):
    return [r[name] for r in df.orderBy("vid").collect()]


def test_degree_and_printing(tiny):
    assert column(alg.degree(tiny), "degree") == DEGREE
    assert column(stats.printed(alg.degree(tiny), "degree"), "text")[3] == "Degree=3"


@pytest.mark.parametrize(("muted", "golden"), [(True, PARITY), (False, TEXTBOOK)])
@pytest.mark.parametrize("split", [True, False])
def test_pagerank(tiny, muted, golden, split):
    ranks, metrics = alg.pagerank(tiny, 20, mute_zero_indegree=muted, split=split)
    assert column(ranks, "rank") == pytest.approx(golden, abs=1e-6)
    assert metrics.iterations == 20


def test_pagerank_until_converged(tiny):
    ranks, metrics = alg.pagerank(tiny)
    assert metrics.iterations == 29
    assert sum(column(ranks, "rank")) == pytest.approx(3.471041, abs=1e-6)


def test_bfs(tiny):
    found, metrics = alg.bfs(tiny, 1)
    assert column(found, "hops") == HOPS
    assert column(found, "parent") == PARENT
    assert metrics.iterations == 3
    assert column(stats.printed(found, "bfs"), "text")[:2] == ["Parent=0,Hops=INF", "Parent=1,Hops=0"]


def test_sssp(tiny):
    found, metrics = alg.sssp(tiny, 1)
    assert (column(found, "distance"), metrics.iterations) == (WEIGHTED, 5)
    found, metrics = alg.sssp(tiny, 1, unit=True)
    assert (column(found, "distance"), metrics.iterations) == (UNIT, 4)


def test_components(tiny):
    found, metrics = alg.connected_components(tiny, "propagate")
    assert (column(found, "label"), metrics.iterations) == (LABEL, 3)
    assert column(alg.connected_components(tiny)[0], "label") == LABEL


def test_components_of_random_graphs_agree(spark):
    rng = random.Random(3)
    for n in (1, 30, 200):
        pairs = [(rng.randrange(n + 1), rng.randrange(n + 1), 1) for _ in range(n)]
        root = list(range(n + 1))

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, _ in pairs:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        assert column(alg.connected_components(Graph(spark.createDataFrame(pairs, WEIGHTED_EDGE), n))[0], "label") == [top(v) for v in range(n + 1)]


def test_results_do_not_depend_on_layout(tiny):
    other = Graph(tiny.edges.repartition(7), 10)
    assert column(alg.sssp(other, 1)[0], "distance") == WEIGHTED
    assert column(alg.pagerank(other, 20)[0], "rank") == pytest.approx(PARITY, abs=1e-6)


def test_classes_and_stats(tiny):
    classes = column(classify.vertex_classes(tiny), "vclass")
    assert classes == ["isolated", "regular", "regular", "regular", "regular", "only_out", "only_in", "isolated", "only_out", "only_in", "isolated"]
    row = stats.value_stats(alg.degree(tiny), "degree").first()
    assert (row["sum"], row["mode"], row["max_value"], row["max_vid"]) == (10, 0, 3, 3)
    assert row["std"] == pytest.approx(math.sqrt(sum((d - 10 / 11) ** 2 for d in DEGREE) / 11))
    assert stats.checksum(alg.degree(tiny), "degree", 0).first()["reachable"] == 6


def test_load_flags(tiny):
    g = ingest.build_graph(tiny.edges, 10, directed=False)
    assert g.edges_kept() == 20
    assert ingest.build_graph(tiny.edges, 10, directed=False, self_loops=False, parallel_edges=False).edges_kept() == 16
    least = {(r.src, r.dst): r.weight for r in ingest.drop_parallel(tiny.edges).collect()}
    assert least[3, 2] == 2
    with pytest.raises(Exception, match="outside"):
        ingest.build_graph(tiny.edges, 8).edges.collect()


def test_files(spark, tiny, tmp_path):
    want = sorted(TINY)
    io.write_text(tiny.edges, str(tmp_path / "t"))
    io.write_binary(tiny.edges.repartition(3), str(tmp_path / "b"))
    for path in ("t", "b"):
        assert sorted(map(tuple, io.read_edges(spark, str(tmp_path / path), weighted=True).collect())) == want
    (tmp_path / "c.txt").write_text("# a\n% b\n1 2\n\n4294967295 0\n")
    assert sorted(map(tuple, io.read_edges(spark, str(tmp_path / "c.txt")).collect())) == [(1, 2), (4294967295, 0)]
    assert io.comment_lines(spark, str(tmp_path / "c.txt")).count() == 2
    (tmp_path / "d.txt").write_text("1  2\n")
    with pytest.raises(Exception, match="not 2 numbers"):
        io.read_edges(spark, str(tmp_path / "d.txt")).collect()
    stats_row = io.convert(spark, str(tmp_path / "b"), str(tmp_path / "e"), source_weighted=True, target_format="text", offset=3).first()
    assert (stats_row["edges"], stats_row["max_id"]) == (10, 12)


def test_binary_folder_with_empty_parts(spark, tiny, tmp_path):
    io.write_binary(tiny.edges.repartition(3), str(tmp_path / "b"))
    (tmp_path / "b" / "part-0.bin").touch()  # the first by name, as tasks without rows leave them
    assert io.sniff_format(spark, str(tmp_path / "b")) == "binary"
    assert sorted(map(tuple, io.read_edges(spark, str(tmp_path / "b"), weighted=True).collect())) == sorted(TINY)
    io.write_binary(tiny.edges.limit(0), str(tmp_path / "none"))
    (tmp_path / "bare").mkdir()
    for path in ("none", "bare"):
        assert io.read_edges(spark, str(tmp_path / path), weighted=True).collect() == []


def test_empty_graph(spark):
    empty = Graph(spark.createDataFrame([], WEIGHTED_EDGE), 2)
    assert column(alg.degree(empty), "degree") == [0, 0, 0]
    assert column(alg.pagerank(empty, 3)[0], "rank") == [0.15] * 3
    assert column(alg.bfs(empty, 1)[0], "hops") == [INF, 0, INF]
    assert column(alg.connected_components(empty)[0], "label") == [0, 1, 2]


def exchanges_above_cache(df):
    """Shuffles and sorts between the join and the cached edges, its left side."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    cache = next(i for i, x in enumerate(lines) if i > join and "InMemoryTableScan" in x)
    return sum("Exchange" in x or "Sort " in x for x in lines[join + 1 : cache])


def test_a_superstep_does_not_exchange_the_edges(spark, tiny):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for split in (None, 2):
            dealt = program.deal(tiny.edges, split)
            assert (dealt.parts is None) == (split is None)
            joined = dealt.joined(tiny.vertices().select(F.col("vid").alias("src"), F.lit(1).alias("m")))
            assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
            assert exchanges_above_cache(joined) == 0
            assert joined.count() == 10
            dealt.release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hubs_are_split(tiny, monkeypatch):
    monkeypatch.setattr(program, "SPLIT", 1)
    monkeypatch.setattr(hot, "LEAST", 0)
    assert column(alg.sssp(tiny, 1)[0], "distance") == WEIGHTED
    assert column(alg.bfs(tiny, 1)[0], "parent") == PARENT
    assert column(alg.pagerank(tiny, 20, mute_zero_indegree=False)[0], "rank") == pytest.approx(TEXTBOOK, abs=1e-6)
    assert column(alg.connected_components(tiny)[0], "label") == LABEL


def test_long_paths_outlive_written_states(spark):
    n = 3 * program.CHECK + 2
    path = Graph(spark.createDataFrame([(i, i + 1, 2) for i in range(n)], WEIGHTED_EDGE), n)
    found, metrics = alg.sssp(path, 0)
    assert column(found, "distance") == [2 * i for i in range(n + 1)]
    assert metrics.iterations == n + 1 == len(metrics.step_seconds)
    assert {r[0] for r in metrics.rows()} == {"ingress", "initial", "superstep", "execute", "end_to_end"}
    assert metrics.execute_seconds >= sum(metrics.step_seconds)


def test_a_program_with_a_fixed_count_of_supersteps_stops_early(spark):
    path = Graph(spark.createDataFrame([(i, i + 1, 1) for i in range(6)], WEIGHTED_EDGE), 6)
    hops = program.VertexProgram(
        name="hops", initial={"h": F.when(F.col("vid") == 0, 0).cast("long")}, active=F.col("vid") == 0, message=F.col("h"), edge_op=lambda m, w: m + 1, combine="min",
        apply=lambda total, i: {"h": F.coalesce("h", total)}, changed=lambda total, i: F.col("h").isNull(),
    )
    found, metrics = program.run(path, hops, 2)
    assert (column(found, "h"), metrics.iterations) == ([0, 1, 2, None, None, None, None], 2)
    with pytest.raises(ValueError, match="order"):
        program.run(path, hops, 2, order="diagonal")


def test_ids_outside_the_universe_fail(tiny):
    for run in (alg.degree, lambda g: alg.pagerank(g, 2)[0], lambda g: alg.bfs(g)[0], lambda g: alg.sssp(g)[0], lambda g: alg.connected_components(g)[0]):
        with pytest.raises(Exception, match="outside"):
            run(Graph(tiny.edges, 8)).collect()


def test_load_and_apps(spark, tiny, tmp_path):
    io.write_text(tiny.edges, str(tmp_path / "t"))
    io.write_binary(tiny.edges, str(tmp_path / "b"))
    for path in ("t", "b"):
        g = ingest.load(spark, str(tmp_path / path), 10, weighted=True, self_loops=False)
        assert (g.records_read, g.edges_kept()) == (10, 9)
        assert g.ingress_seconds > 0
        done = apps.run_app("sssp", spark, str(tmp_path / path), 10, root=1, weighted=True)
        assert [r.text for r in done.shown.collect()] == [f"Distance={'INF' if d == INF else d}" for d in WEIGHTED]
        assert done.checksum.first()["reachable"] == sum(d != INF for d in WEIGHTED)
        assert done.metrics.ingress_seconds == done.graph.ingress_seconds
    with pytest.raises(Exception, match="outside"):
        ingest.load(spark, str(tmp_path / "b"), 5, weighted=True).edges.collect()


def test_hash_weights_spread(spark):
    found = io.hash_weights(spark.range(20_000).selectExpr("id AS src", "id * 7 AS dst")).groupBy("weight").count().collect()
    assert {r.weight for r in found} == set(range(1, 129))
    assert max(r["count"] for r in found) < 2 * 20_000 / 128
