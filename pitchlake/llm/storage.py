"""Reading the driver's tables, cutting lineage in shared storage, and giving memory back in tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``; the path may belong to any file system Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="pitchlake-"))
    return "file://" + _LOCAL_DIR[0]


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan above starts from files any executor can read, so a lost executor costs a reread, not a recomputation of
    everything below, and Spark knows the real size when it chooses joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pitchlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``durable``, with the rows of a ``key`` in one bucket: what groups by it moves none of them."""
    spark = df.sparkSession
    name = f"pitchlake_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).format("parquet").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``, a total order: a written range shuffle and its partitions' sizes,
    so that no task sees all rows."""
    placed = df.orderBy(*order).withColumns({"_part": F.spark_partition_id().cast("long"), name: F.monotonically_increasing_id()})
    placed = durable(placed.withColumn(name, F.col(name) - F.shiftleft("_part", 33)))
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):  # a row a partition
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def released() -> None:
    """Give freed memory back to the system. Spark uses a Python worker for one stage after another, and what an operator
    freed would else stand beside what the next one needs. Does nothing where the C library has no such call."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` on a task's batches, after which the task's memory is released."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            released()

    return run
