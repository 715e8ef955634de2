"""Graphs derived from the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparseloom.plans.graph import Graph

#: The edges of each graph as SQL, for oracles; the frames below say the same.
EDGE_SQL = {
    "part_supp": "SELECT l_partkey AS src, l_suppkey AS dst, CAST(l_quantity AS BIGINT) AS weight FROM lineitem",
    "order_part": "SELECT l_orderkey AS src, l_partkey AS dst, CAST(l_quantity AS BIGINT) AS weight FROM lineitem",
    "order_cust": "SELECT o_orderkey AS src, o_custkey AS dst, 1 + o_orderkey % 127 AS weight FROM orders",
    "user_next": """SELECT src, dst, weight FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst,
        CAST(floor(abs(value)) AS BIGINT) % 100 + 1 AS weight FROM events) WHERE dst IS NOT NULL""",
}


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name in ("part_supp", "order_part"):
        src, dst = ("l_partkey", "l_suppkey") if name == "part_supp" else ("l_orderkey", "l_partkey")
        return table("lineitem").select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col("l_quantity").cast("long").alias("weight"))
    if name == "order_cust":
        return table("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), (F.col("o_orderkey") % 127 + 1).alias("weight"))
    if name == "user_next":
        following = F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
        found = table("events").select(F.col("user_id").alias("src"), following.alias("dst"), (F.floor(F.abs("value")).cast("long") % 100 + 1).alias("weight"))
        return found.filter(F.col("dst").isNotNull())
    raise ValueError(f"unknown graph {name!r}")


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    found = edges(spark, sf_dir, name)
    most = found.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return Graph(found, int(most or 0))
