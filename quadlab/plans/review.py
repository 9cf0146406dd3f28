"""Applying review decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadlab.functions import geometry as G
from quadlab.functions.fence import computed
from quadlab.operators.joins import KEY, deleted_overlays, effective_labels, only_names, without_names
from quadlab.operators.metrics import evaluate_pairs


def review_removals(index: DataFrame, existing: DataFrame, samples: DataFrame) -> DataFrame:
    """Names whose overlay was deleted: ``in_split`` tells whether the record's split still has them."""
    gone = deleted_overlays(index, existing).select(*KEY).distinct()
    have = samples.select(*KEY, F.lit(1).alias("hit"))
    return gone.join(have, KEY, "left").select(*KEY, F.col("hit").isNotNull().alias("in_split"))


def apply_review_deletions(index: DataFrame, existing: DataFrame, samples: DataFrame) -> DataFrame:
    """Splits without the deleted names; a name deleted in one split leaves both."""
    return without_names(samples, review_removals(index, existing, samples).where("in_split"))


def deletion_report(index: DataFrame, existing: DataFrame, samples: DataFrame) -> DataFrame:
    """Per split: rows before and after, removed names, and names already absent from that split."""
    removals = review_removals(index, existing, samples)
    after = only_names(samples, removals.where("in_split").select("name").distinct())
    left = samples.groupBy("split").agg(F.count("*").alias("n_before"))
    lost = after.groupBy("split").agg(F.count("*").alias("n_removed"))
    absent = removals.groupBy("split").agg(F.count_if(~F.col("in_split")).alias("n_absent"))
    out = left.join(lost, "split", "left").join(absent, "split", "left").fillna(0)
    return out.withColumn("n_after", F.col("n_before") - F.col("n_removed"))


def apply_review_state(rows: DataFrame, state: DataFrame, img_size: float = 224.0) -> DataFrame:
    """Rows (split, name, is_negative, gt, pred) with edits applied and metrics against the effective label."""
    out = effective_labels(rows, state).withColumnRenamed("gt", "original").withColumnRenamed("effective", "gt")
    out = evaluate_pairs(out, img_size)
    return computed(out, {"gt_min_angle": F.least(*G.interior_angles(F.col("gt")))})


def cleaned_split(reviewed: DataFrame) -> DataFrame:
    return reviewed.where(~F.col("discarded"))


def edited_labels(reviewed: DataFrame) -> DataFrame:
    return reviewed.where("modified").select("name", F.col("gt").alias("coords"))
