"""Where to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only on a local master with none set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows, and their partitions, stay as written even if executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, shared by all executors."""
    return f"{ensure_checkpoint_dir(spark)}/quadlab-{uuid.uuid4().hex}"
