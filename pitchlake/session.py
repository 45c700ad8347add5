"""Session factory: UTC, adaptive execution, partitions sized for the machine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("pitchlake")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir(df: DataFrame) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests, one of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pitchlake-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the checkpoint folder."""
    _checkpoint_dir(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``checkpointed`` for wide tables that are read several times: compressed columns, of which a reader takes its own."""
    path = f"{_checkpoint_dir(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
