"""Session helpers: durable cut points of a lineage, row bounds."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    A folder of its own machine would be lost to the other executors, so only a
    local session, where all are one process, gets a new one where unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and read it from there.

    Used where two consumers must see the same rows even if an executor is
    lost between them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet to the checkpoint folder and read it from there.

    As ``durable``, for frames whose consumers read different columns.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    typed = df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType.typeName() == "void"})
    typed.write.parquet(path)
    return df.sparkSession.read.schema(typed.schema).parquet(path)


_TABLES: set[str] = set()


def bucketed_once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], by: str = "code", order: str | None = None, least: int = 1) -> DataFrame:
    """The table that ``build`` makes of ``source``, written once for an application, bucketed by ``by``.

    Later reads find the rows dealt by ``by`` and sorted, so windows and joins on
    it need no exchange. The number of buckets is that of shuffle partitions, or
    ``least`` if that is more, so that a large table's bucket can be sorted in memory.
    """
    buckets = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mark = hashlib.sha256(f"{spark.sparkContext.applicationId} {source} {buckets}".encode()).hexdigest()[:16]
    table = f"asofia_{name}_{mark}"
    if table not in _TABLES:
        df = build().repartition(buckets, by)
        path = f"{ensure_checkpoint_dir(spark)}/{table}"
        df.write.mode("overwrite").bucketBy(buckets, by).sortBy(by, *([order] if order else [])).option("path", path).saveAsTable(table)
        _TABLES.add(table)
    return spark.table(table)


def row_bound(spark: SparkSession, *paths: str) -> int:
    """Number of rows of the given Parquet tables, read from their footers.
    """
    return sum(spark.read.parquet(p).count() for p in paths)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the cluster has cores.

    For CPU-heavy text work on few, unsplittable files. A scan that is already
    wide enough is returned as it is, so large inputs are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
