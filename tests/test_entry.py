"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sparseloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "events")
#: Long runs of a program that another query runs as well; the driver's gate compares these too.
REPEATS = {
    "pagerank_1", "pagerank_20", "pagerank_plain_5", "pagerank_textbook_20", "pagerank_checksum", "pagerank_converged", "bfs_printed", "bfs_level_counts", "sssp_unit",
    "sssp_reachable", "cc_count", "connected_components", "app_pagerank", "app_bfs",
}


def rows(frame):
    names = sorted(frame.columns)
    values = frame[names].astype(object).where(frame[names].notna(), None).values.tolist()
    return names, sorted(([round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r] for r in values), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(ORACLES) - REPEATS))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(ORACLES[name]).df())


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
