"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of this machine where all of Spark runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if spark.conf.get("spark.master", "").partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="examlake-tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row, however often later columns use them: projections above do not take their expressions in."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("made_once")
    return df.select(*(c for c in df.columns if c not in columns), made).select("*", "made_once.*").drop("made_once")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame under spark.checkpoint.dir and read it again, so that its plan and lineage end there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that what the JVM and Python hold of nested rows does not grow with a partition."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        held = int(str(spark.conf.get(name)).rstrip("b"))
        if held <= 0 or held > most:
            spark.conf.set(name, str(most))
