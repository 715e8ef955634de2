"""Contiguous shards of near equal bytes, cut from global prefix sums.

Rows are put in order, dealt by range over partitions and written with their partition's
number. Each partition's total comes first; the running sum over those few totals gives
every partition its base, and a window inside the partition gives every row its place on
the global byte line. The line is cut at equal targets: a row belongs to the shard that
holds its middle byte. So two shards differ by less than the two rows at their edges.

Cases: null text counts as empty; null and repeated ids keep their own rows (null ids come
last, repeats in the order of their files' hashes); a very long text is a row like any other, and its shard may
exceed the target by it; an empty table gives no rows; other columns are not read, whatever their names. Equal texts are not kept together: a shard is a run of ids, whatever they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, prefix_sums, spool, with_locator

#: Bytes that a row costs beside its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row of ``docs``; slot counts from 0 in a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_locator(docs, [F.col(id_col), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")])
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(FILE), F.col(ROW)]  # short keys: range partitioning samples them to the driver
    placed = spool(prefix_sums(rows, [], order, "size", "_sl_start", "_sl_index"), "placed")
    total = placed.agg(F.sum("size").cast("decimal(38,0)").alias("_sl_total"))  # one row
    middle = F.col("_sl_start").cast("decimal(38,0)") * 2 + F.col("size")
    cut = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (F.col("_sl_total") * 2)).cast("int")))
    firsts = cut.groupBy(F.col("shard").alias("_sl_shard")).agg(F.min("_sl_index").alias("_sl_first"))  # at most ``shards`` rows
    out = cut.join(F.broadcast(firsts), F.col("shard") == F.col("_sl_shard"))
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("_sl_index") - F.col("_sl_first")).alias("slot"))


def near_equal_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The registered query's columns."""
    out = shard_by_bytes(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
