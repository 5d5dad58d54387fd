"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers that see this folder import the package, and sizes Arrow batches for long texts.

    On a cluster, ship the package with --py-files. A batch size other than Spark's own is left as it is.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, parts)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where everything runs on one machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-tables-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again, for what is needed more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
