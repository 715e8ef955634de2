"""What several operators share: the folder for intermediate tables, row locators,
bounded Arrow batches and prefix sums.

Internal columns start with ``_sl_`` so that they do not clash with columns of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparseloom.plans.storage import delete_files, drop_spooled, new_path, spool  # noqa: F401  for the operators


FILE, ROW = "_sl_file", "_sl_row"
#: Rows and bytes of text that one Arrow batch brings to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_locator(docs: DataFrame, columns: Sequence[str | Column] = ("*",)) -> DataFrame:
    """``columns`` of ``docs`` with FILE and ROW, which together name one row for good.

    A frame that reads Parquet directly has both as metadata. Any other frame is
    spooled first, since row numbers made while a plan runs may differ on a rerun.
    """
    places = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    try:
        found = docs.select(*columns, *places)
        found.schema  # noqa: B018  resolves the names
        return found
    except AnalysisException:
        return spool(docs, "rows").select(*columns, *places)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, and a worker holds a whole batch."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in now or "" if c.isdigit())
        if not digits or not 0 < int(digits) <= most or not (now or "").rstrip("bB").isdigit():
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(spark: SparkSession) -> int:
    """Number of partitions for explicit range and hash partitioning."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, start: str, index: str | None = None) -> DataFrame:
    """Add ``start``: the sum of ``value`` over the rows before, within ``group`` by ``order``;
    and ``index``: the number of those rows.

    No group has to fit one task: the rows are dealt by range of (group, order) and written;
    totals per part and group (as many as there are parts, at the least) are summed in order; a
    window then only runs within a part.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in group]
    placed = spool(df.repartitionByRange(spread(spark), *[k.asc_nulls_last() for k in keys], *order).withColumn("_sl_part", F.spark_partition_id()), "ranges")
    each = placed.groupBy("_sl_part", *group).agg(F.sum(value).alias("_sl_total"), F.count(F.lit(1)).alias("_sl_n"))
    before = Window.partitionBy(*group).orderBy("_sl_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = each.select(
        F.col("_sl_part").alias("_sl_p"),
        *[F.col(c).alias(f"_sl_g{i}") for i, c in enumerate(group)],
        F.coalesce(F.sum("_sl_total").over(before), zero).alias("_sl_base"),
        F.coalesce(F.sum("_sl_n").over(before), zero).alias("_sl_first"),
    )
    within = Window.partitionBy("_sl_part", *group).orderBy(*order)
    same = F.col("_sl_part") == F.col("_sl_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_sl_g{i}"))
    joined = placed.join(bases, same)
    earlier = F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), zero)
    out = [F.col(c) for c in df.columns] + [(F.col("_sl_base") + earlier).cast("long").alias(start)]
    if index:
        out.append((F.col("_sl_first") + F.row_number().over(within) - 1).cast("long").alias(index))
    return joined.select(*out)
