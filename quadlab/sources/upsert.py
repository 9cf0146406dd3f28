"""A keyed table in buckets, of which a batch rewrites only those it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadlab.sources.versions import clean_versions, latest_version, pointer, publish

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, path: str) -> dict:
    return json.loads(pointer(spark, path)) if latest_version(spark, path) else {"batch": -1, "buckets": {}}


def _rows(spark: SparkSession, path: str, state: dict, only: set[int] | None = None) -> DataFrame | None:
    files = [f"{path}/{folder}/__bucket={b}" for b, folder in state["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(state["schema"]).parquet(*files) if files else None


def upsert(batch: DataFrame, path: str, key: str, merge: Callable[[DataFrame], DataFrame], batch_id: int, buckets: int = BUCKETS, keep: int = 8) -> int:
    """Merge a batch into the table at ``path``; how many buckets were rewritten.

    ``merge`` folds stored and new rows, which have the same columns, to one row per ``key``. Only buckets that the batch has keys of are read, folded and written to a new folder; the pointer
    that follows names it for these and the old folders for the rest, and the batch id. A batch that is not after the stored one changes nothing, so replays are safe; a
    failed write leaves the last version. Null keys are one key. The number of buckets is that of the first batch; the driver holds their numbers. One writer at a time.
    """
    spark = batch.sparkSession
    state = _state(spark, path)
    if batch_id <= state["batch"]:
        return 0
    buckets = state.get("n", buckets)
    new = batch.withColumn("__bucket", bucket_of(key, buckets))
    touched = {r[0] for r in new.select("__bucket").distinct().collect()}
    folder = f"data-{uuid.uuid4().hex}"
    schema = state.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    if touched:
        old = _rows(spark, path, state, touched)
        rows = batch if old is None else old.unionByName(batch)
        # the fold has shuffled by key already; a bucket's rows are gathered once more, for one file each
        (merge(rows).withColumn("__bucket", bucket_of(key, buckets)).repartition(len(touched), "__bucket")
         .write.partitionBy("__bucket").parquet(f"{path}/{folder}"))
    publish(spark, path, json.dumps({"batch": batch_id, "n": buckets, "schema": schema, "buckets": state["buckets"] | {str(b): folder for b in touched}}))
    clean_versions(spark, path, keep)
    return len(touched)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest version."""
    state = _state(spark, path)
    rows = _rows(spark, path, state)
    if rows is None:
        if "schema" not in state:
            raise FileNotFoundError(f"{path} has no version")
        return spark.createDataFrame([], state["schema"])
    return rows
