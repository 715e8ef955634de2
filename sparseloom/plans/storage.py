"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session has none, a local master gets a folder below the SQL
    warehouse; on a cluster that is an error, since the folder might not be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparseloom-{uuid.uuid4().hex}-{name}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    That cuts the lineage at a table that outlives lost executors, and fixes values
    that a second run of the plan might give differently.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spool_counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """spool(), and aggregates of the rows that are taken as they are written, without another job.

    A stage that ran again after a lost executor may count rows twice, so only zero and repetition tell anything exact.
    """
    seen = Observation()
    found = spool(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), name)
    return found, seen.get


def drop_spooled(df: DataFrame) -> None:
    """Delete the table behind a frame that spool() returned, once nothing needs it."""
    files = df.inputFiles()
    if files:
        folder = files[0].rpartition("/")[0]
        if re.search(r"/sparseloom-[0-9a-f]{32}-[^/]*$", folder):  # never a table of anyone else's
            delete_files(df.sparkSession, [folder])


def delete_files(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete files, or whole folders, of any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(p) if "://" in p or p.startswith("file:") else p)
        path.getFileSystem(conf).delete(path, True)
