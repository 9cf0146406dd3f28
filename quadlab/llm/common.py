"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadlab.checkpoints import cut, ensure_checkpoint_dir, scratch_dir  # noqa: F401 - used by the operators

#: ASCII white space; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that every engine agrees."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fresh(names: Iterable[str], stem: str) -> str:
    """A column name that is not taken."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: later jobs reread files, not lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def checked(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of a few narrow columns, to be joined: broadcast if it has at most ``most`` rows, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def release(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads, and let Spark's cleaner drop the shuffles of finished steps."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    for df in tables[:1]:
        clean(df)


def clean(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints of finished steps that nothing refers to any more."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
