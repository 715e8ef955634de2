"""Edge lists as text and as fixed-width binary, and the converter between them.

Text: ``src dst[ weight]`` a line, one space between. Binary: little-endian unsigned 32-bit
numbers, two or three a record. Both are read through Spark's own input formats, so any
Hadoop file system works and files are split at records. Text is parsed by built-in functions, binary
records by whole Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

COMMENT = "^[#%]"


def read_text(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Comment (``#``, ``%``) and blank lines are skipped; any other line that is not as it should be fails the read."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(COMMENT) & (F.trim("value") != ""))
    arity = 3 if weighted else 2
    parts = F.split("value", " ")
    good = F.col("value").rlike(r"^\d+" + r" \d+" * (arity - 1) + "$")
    checked = F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit(f"not {arity} numbers: "), F.col("value"))).cast("array<string>"))
    return lines.select(checked.alias("p")).select(*[F.col("p")[i].cast("long").alias(c) for i, c in enumerate(("src", "dst", "weight")[:arity])])


def comment_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").rlike(COMMENT))


def read_binary(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Hadoop's fixed-length input splits the files at records; the bytes of a batch of records are read as one array."""
    names = ("src", "dst", "weight")[: 3 if weighted else 2]
    width = 4 * len(names)
    jvm, session = spark.sparkContext._jvm, spark._jsparkSession
    records = session.sparkContext().binaryRecords(path, width, spark.sparkContext._jsc.hadoopConfiguration())
    rows = DataFrame(session.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0).cast(pa.large_binary())
            _, ends, data = column.buffers()
            first, last = np.frombuffer(ends, np.int64)[[column.offset, column.offset + len(column)]] if len(column) else (0, 0)
            numbers = np.frombuffer(data or b"", np.uint8)[first:last].view("<u4").reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[:, k].astype(np.int64)) for k in range(len(names))], names=list(names))

    return rows.mapInArrow(decoded, ", ".join(f"{n} long" for n in names))


def sniff_format(spark: SparkSession, path: str) -> str:
    """``text`` if the first bytes are printable ASCII, else ``binary``. Reads a few bytes, runs no program.

    Of a folder, the first file that is not empty tells: a task without rows leaves an empty part.
    Where nothing has a byte it is ``text``, which has no rows either.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isFile() and s.getLen() > 0)
        shown = [n for n in names if n.rpartition("/")[2][0] not in "._"]
        if not shown:
            return "text"
        where = jvm.org.apache.hadoop.fs.Path(shown[0])
    stream = fs.open(where)
    try:
        found = [stream.read() for _ in range(64)]
    finally:
        stream.close()
    return "text" if all(b in (9, 10, 13) or 32 <= b < 127 for b in found if b >= 0) else "binary"


def read_edges(spark: SparkSession, path: str, fmt: str | None = None, weighted: bool = False) -> DataFrame:
    fmt = fmt or sniff_format(spark, path)
    if fmt not in ("text", "binary"):
        raise ValueError(f"unknown edge format {fmt!r}")
    return (read_text if fmt == "text" else read_binary)(spark, path, weighted)


def write_text(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", *edges.columns)).write.text(path)


class _Written(WriterCommitMessage):
    pass


class _BinaryWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path)
        system.create_dir(base)
        name, hidden = f"{base}/part-{uuid.uuid4().hex}.bin", f"{base}/.part-{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as out:
            for batch in iterator:
                columns = [batch[c].to_numpy(zero_copy_only=False) for c in self.columns]
                for c in columns:
                    if len(c) and (c.min() < 0 or c.max() > 0xFFFFFFFF):
                        raise ValueError("a number that 32 bits cannot hold")
                out.write(np.stack(columns, axis=1).astype("<u4").tobytes())
        system.move(hidden, name)  # a task that fails leaves no part
        return _Written()


class BinaryEdges(DataSource):
    """Sink ``edge_binary``: records of the frame's columns as little-endian unsigned 32-bit numbers."""

    @classmethod
    def name(cls) -> str:
        return "edge_binary"

    def writer(self, schema, overwrite: bool) -> _BinaryWriter:
        return _BinaryWriter(self.options["path"], schema.fieldNames())


def write_binary(edges: DataFrame, path: str) -> None:
    """To a folder in any file system that pyarrow opens by its URI."""
    edges.sparkSession.dataSource.register(BinaryEdges)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    edges.write.format("edge_binary").mode("append").save(uri)


def offset_ids(edges: DataFrame, offset: int) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select((F.col("src") + offset).alias("src"), (F.col("dst") + offset).alias("dst"), *rest)


#: A prime modulus and full-period multipliers for it (Park and Miller 1988; Fishman and Moore 1986).
PRIME, MULTIPLIERS = 2147483647, (16807, 48271, 69621)


def hash_weights(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Weights from 1 to 128 that depend on the edge and the seed only, by arithmetic that any SQL has."""
    step, of_src, of_dst = MULTIPLIERS
    mixed = F.pmod(F.pmod("src", F.lit(PRIME)) * of_src + F.pmod("dst", F.lit(PRIME)) * of_dst + F.lit(seed % PRIME), F.lit(PRIME))
    # Low bits of one step are poor; the quotient by the modulus' 128th part is not.
    return edges.select("src", "dst", (F.floor(F.pmod(mixed * step, F.lit(PRIME)) / F.lit(PRIME // 128 + 1)) + 1).cast("long").alias("weight"))


def drop_weights(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst")


def edge_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, and the largest id, which is the number of vertices beside zero."""
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.max(F.greatest("src", "dst")).alias("max_id"))


def source_lines(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """One row: comment lines of a text source, none of a binary one."""
    if (fmt or sniff_format(spark, path)) == "binary":
        return spark.range(1).select(F.lit(0).cast("long").alias("comments"))
    return spark.read.text(path).agg(F.count_if(F.col("value").rlike(COMMENT)).alias("comments"))


def convert(spark: SparkSession, source: str, target: str, *, source_format: str | None = None, source_weighted: bool = False, target_format: str = "binary", target_weighted: bool = False, offset: int = 0, seed: int = 0) -> DataFrame:
    """Read, shift ids, add or drop weights, write; one row of what was read and written: edges, max_id,
    comments, and lines (edges and comments)."""
    edges = read_edges(spark, source, source_format, source_weighted)
    if offset:
        edges = offset_ids(edges, offset)
    if target_weighted and not source_weighted:
        edges = hash_weights(edges, seed)
    elif source_weighted and not target_weighted:
        edges = drop_weights(edges)
    if target_format not in ("text", "binary"):
        raise ValueError(f"unknown edge format {target_format!r}")
    (write_text if target_format == "text" else write_binary)(edges, target)
    written = edge_stats(read_edges(spark, target, target_format, target_weighted))
    return written.crossJoin(source_lines(spark, source, source_format)).withColumn("lines", F.col("edges") + F.col("comments"))  # one row each
