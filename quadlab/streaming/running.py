"""Running forms over streams of evaluated rows and review events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from quadlab.operators.accumulator import MetricAccumulator
from quadlab.operators.joins import folded, review_rows, review_state
from quadlab.operators.ranking import lowest_k
from quadlab.sources.upsert import BUCKETS, read_upserted, upsert
from quadlab.sources.versions import latest_version, read_version, write_version

#: Versions that a running table keeps; readers that take longer pin theirs.
KEEP = 8


def running_metrics(stream: DataFrame, table_path: str, checkpoint: str, by: Sequence[str] = ("split",)) -> DataStreamWriter:
    """Keep the whole detection report of all rows seen so far, as a stored state.

    A batch's rows become a state of one row per group, which is merged with the stored one; ``MetricAccumulator(spark, table_path, by).compute()`` is the report at any time.
    A batch replayed after a failure changes nothing.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        MetricAccumulator(batch.sparkSession, table_path, by, KEEP).update(batch, batch_id)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def running_worst(stream: DataFrame, k: int, table_path: str, checkpoint: str, value: str = "iou") -> DataStreamWriter:
    """Keep the ``k`` lowest rows seen so far as a versioned table, of which the last KEEP versions stay.

    Each batch merges its own lowest rows with the stored ones; k bounds both sides. The batch id is
    stored with the rows, so a batch replayed after a failure changes nothing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = lowest_k(batch, k, value).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        if latest_version(spark, table_path):
            old = read_version(spark, table_path)
            new = old.where(F.col("batch_id") < batch_id).unionByName(new)
        write_version(lowest_k(new, k, value), table_path, keep=KEEP)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def running_review_state(events: DataFrame, table_path: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Keep the review state of every name as a keyed table; a batch rewrites the buckets of its names only, and a replayed batch nothing."""
    def add(batch: DataFrame, batch_id: int) -> None:
        upsert(review_rows(batch), table_path, "name", folded, batch_id, buckets, KEEP)
    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def current_review_state(spark, table_path: str) -> DataFrame:
    """``name, discarded, edited, n_edits`` of all names with events so far: the same as ``fold_events`` over them."""
    return review_state(read_upserted(spark, table_path))
