"""Exact deduplication with keyed state on disk.

A stream reads (digest, id, locator) rows and aggregates them by digest in RocksDB state
that never expires: per digest the largest id, that row's place (file and row number) and
the number of rows. The stream's checkpoint lies in the shared folder, so the state
outlives executors and later feeds can go on from it. The state is then written as a table
and joined with the fed rows; groups of very many copies are broadcast to their rows.

Hits are checked by full bytes: rows are counted by (digest, text), which combines copies
before the shuffle, and a digest that more than one text has is settled by the texts
themselves. Everything runs as Spark's own operators.

Cases: null text is the empty text; a null id ranks below all others; rows repeated with
their id are told apart by their place, so one row of a group is kept always; a very long text is
digested whole; an empty table gives no rows; other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.plans.hot import hot_limit, join_hot

from .common import FILE, ROW, ascii_lower, new_path, spool, with_locator

#: For the stream and for reading its state. There is a store for each partition: none claims disk ahead, and all
#: on an executor share a bounded part of its memory.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}

DIGEST, BYTES = "_sl_digest", "_sl_text"


def rank() -> Column:
    """Compared as a whole: the id first (null lowest), then the place."""
    return F.struct(F.col("_sl_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """``values`` as session settings, for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def keyed_state(spark: SparkSession, feed: DataFrame, feed_path: str, checkpoint: str) -> DataFrame:
    """Run the stream over what is new below ``feed_path``; then the written table of all state so far: (digest, keep, n)."""
    with settings(spark, STORES):
        groups = spark.readStream.schema(feed.schema).parquet(feed_path).groupBy(DIGEST).agg(F.max(rank()).alias("keep"), F.count(F.lit(1)).alias("n"))
        run = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        if run.lastProgress is None:  # nothing was fed, so there is no state
            return groups_of(feed).limit(0)
        state = spark.read.format("statestore").load(checkpoint)
        keep, n = state.schema["value"].dataType.fieldNames()
        return spool(state.select(F.col(f"key.{DIGEST}").alias(DIGEST), F.col("value")[keep].alias("keep"), F.col("value")[n].alias("n")), "state")


def groups_of(feed: DataFrame) -> DataFrame:
    return feed.groupBy(DIGEST).agg(F.max(rank()).alias("keep"), F.count(F.lit(1)).alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: (_sl_id, FILE, ROW, DIGEST, keep, n); keep is the row that stays."""
    spark = docs.sparkSession
    located = with_locator(docs, [F.col(id_col).alias("_sl_id"), F.col(text_col).alias(BYTES)])
    keyed = located.withColumn(BYTES, ascii_lower(F.col(BYTES))).withColumn(DIGEST, digest(F.col(BYTES)))
    base = new_path(spark, "exact")
    keyed.drop(BYTES).write.parquet(f"{base}/feed")
    feed = spark.read.schema(keyed.drop(BYTES).schema).parquet(f"{base}/feed")
    state = keyed_state(spark, feed, f"{base}/feed", f"{base}/state")
    by_text = keyed.groupBy(DIGEST, BYTES).agg(F.count(F.lit(1)).alias("n"))
    clashing = spool(by_text.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1").select(DIGEST), "clashing")
    # A group of copies may hold a great part of all rows.
    rows = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    grouped = join_hot(feed, state, DIGEST, "n", hot_limit(spark, rows))
    if clashing.isEmpty():
        return grouped
    plain = grouped.join(clashing, DIGEST, "left_anti")
    inside = keyed.join(clashing, DIGEST, "left_semi")
    settled = inside.groupBy(DIGEST, BYTES).agg(F.max(rank()).alias("keep"), F.count(F.lit(1)).alias("n"))
    return plain.unionByName(inside.join(settled, [DIGEST, BYTES]).drop(BYTES))


def stays() -> Column:
    return (F.col("keep.file") == F.col(FILE)) & (F.col("keep.row") == F.col(ROW))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """The registered query's columns, one row per document."""
    rows = exact_groups(docs)
    return rows.select(F.col("_sl_id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), stays().alias("kept"), F.lower(F.hex(DIGEST)).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    spark = docs.sparkSession
    keepers = exact_groups(docs, id_col, text_col).filter(stays()).select(F.col(FILE).alias("_sl_f"), F.col(ROW).alias("_sl_r"))
    located = with_locator(docs)
    return located.join(keepers, (F.col(FILE) == F.col("_sl_f")) & (F.col(ROW) == F.col("_sl_r"))).select(*[located[c] for c in docs.columns])
