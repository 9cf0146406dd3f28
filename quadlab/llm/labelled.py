"""Labels of documents, the held-out part, and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The most labelled rows a model is fitted on: those with the smallest hash of their id. All rows are scored.
SAMPLE = 12_000


def remainder(by: int) -> Column:
    """crc32 of the id's text, modulo ``by``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def sample(rows: DataFrame, labels: DataFrame, label: str, usable: Column, most: int = SAMPLE) -> DataFrame:
    """Up to ``most`` of the usable labelled rows, with ``y``. Repeated labels of an id count by majority, missing ones not at all."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.avg(label) >= 0.5).cast("int").alias("y")).where(usable))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return rows.join(picked, "doc_id")
