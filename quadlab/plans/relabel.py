"""Jobs that replace labels or bring in new samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quadlab.functions import names as N
from quadlab.functions.geometry import clip01, order_tlbr_angle, order_tlbr_sumdiff
from quadlab.functions.overlap import with_polygon_iou
from quadlab.operators.joins import join_labels, join_predictions, with_membership, without_names


def rebuild_with_teacher_labels(samples: DataFrame, ious: DataFrame, preds: DataFrame, source: str = "teacher",
                                protected: Sequence[str] = ("midv", "smartdoc"), threshold: float = 0.97) -> DataFrame:
    """Negatives, protected prefixes and rows with IoU >= threshold, labelled by the teacher.

    label_status: written, empty (negative or undetected) or missing_pred.
    """
    name = F.col("name")
    neg, prot = N.is_negative(name, ignore_case=True), N.has_prefix(name, protected)
    rows = samples.join(ious.select("split", "name", "iou"), ["split", "name"], "left")
    rows = rows.where(prot | neg | (F.col("iou") >= threshold))
    rows = join_predictions(rows, preds, source, "teacher")
    quad = F.when(~neg, F.col("teacher"))
    kind = F.when(neg, F.lit("negative"))
    for p in protected:
        kind = kind.when(N.has_prefix(name, [p]), F.lit(p))
    status = (F.when(neg, F.lit("empty")).when(F.col("has_row") == 0, F.lit("missing_pred"))
              .when(quad.isNotNull(), F.lit("written")).otherwise(F.lit("empty")))
    return rows.select("split", "name", kind.otherwise(F.lit("other_iou_ge")).alias("kind"),
                       quad.alias("coords"), status.alias("label_status"))


def new_candidates(labelled: DataFrame, preds: DataFrame, known: DataFrame, source: str = "teacher",
                   threshold: float = 0.97) -> DataFrame:
    """Labelled samples with detection, IoU (corners ordered by sum and difference) and membership.

    ``labelled``: split, name, gt. A row is new when detected, IoU >= threshold and not in ``known``.
    """
    rows = join_predictions(labelled.where(F.col("gt").isNotNull()), preds, source)
    # clipped in a projection of its own: the order reads each coordinate many times
    rows = rows.withColumn("__clipped", clip01(F.col("pred")))
    rows = rows.withColumns({"g": order_tlbr_sumdiff(F.col("gt")), "p": order_tlbr_sumdiff(F.col("__clipped"))}).drop("__clipped")
    rows = with_membership(with_polygon_iou(rows, [("p", "g", "iou")]), known, "in_known")
    return rows.select("split", "name", "in_known", "detected", "iou",
                       ((F.col("in_known") == 0) & F.coalesce(F.col("iou") >= threshold, F.lit(False))).alias("is_new"))


def import_candidates(candidates: DataFrame, images: DataFrame, report: DataFrame, existing: DataFrame,
                      overwrite: bool = False) -> DataFrame:
    """Status of each candidate, by rule order.

    ``images``: name; ``report``: name, status, coords; ``existing``: names that already have a label.
    """
    rows = (candidates.select("name")
            .join(images.select("name").distinct().withColumn("img", F.lit(1)), "name", "left")
            .join(report.select("name", F.col("status").alias("det"), "coords", F.lit(1).alias("rep")), "name", "left")
            .join(existing.select("name").distinct().withColumn("lbl", F.lit(1)), "name", "left"))
    status = (F.when(F.col("img").isNull(), F.lit("missing_source_image"))
              .when(F.col("rep").isNull(), F.lit("missing_teacher_pred"))
              .when(F.coalesce(F.col("det") != "OK", F.lit(True)), F.lit("teacher_not_ok"))
              .when(F.coalesce(F.size("coords") != 8, F.lit(True)), F.lit("missing_teacher_pred"))
              .when(F.col("lbl").isNotNull() & F.lit(not overwrite), F.lit("label_exists"))
              .otherwise(F.lit("written")))
    return rows.select("name", status.alias("status"), "coords")


def empty_annotations(samples: DataFrame, labels: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Positives of the given prefixes without any annotation."""
    name = F.col("name")
    rows = samples.where(~N.is_negative(name, ignore_case=True) & N.has_prefix(name, prefixes))
    rows = join_labels(rows, labels).where(F.col("gt_valid") == 0)
    return rows.select("split", "name", N.first_token(name).alias("token"))


def remove_empty_annotations(samples: DataFrame, labels: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Splits without those samples; a name empty in one split leaves both."""
    return without_names(samples, empty_annotations(samples, labels, prefixes))


def relabel_by_prefix(samples: DataFrame, labels: DataFrame, preds: DataFrame, prefixes: Sequence[str],
                      source: str = "docaligner", only_if_empty: bool = False) -> DataFrame:
    """New label for matching samples where the source detects; otherwise the old one stays.

    status: relabelled, not_detected or skipped_nonempty.
    """
    rows = samples.where(N.has_prefix(F.col("name"), prefixes))
    rows = join_predictions(join_labels(rows, labels), preds, source)
    skip = F.col("gt").isNotNull() & F.lit(only_if_empty)
    new = clip01(order_tlbr_angle(F.col("pred")))
    status = (F.when(skip, F.lit("skipped_nonempty")).when(F.col("pred").isNull(), F.lit("not_detected"))
              .otherwise(F.lit("relabelled")))
    rows = rows.withColumn("status", status)
    return rows.select("split", "name", "status", "conf",
                       F.when(F.col("status") == "relabelled", new).otherwise(F.col("gt")).alias("coords"))


def attach_model_labels(lines: DataFrame, scored: DataFrame, threshold: float = 0.5, append: bool = False) -> DataFrame:
    """Label lines (stem, class, coords) with a class-1 line per stem that scores at least ``threshold``.

    Without ``append`` the earlier class-1 lines of those stems go.
    """
    new = scored.where(F.col("score") >= threshold).select("stem", F.lit(1).alias("class"), "coords")
    old = lines.select("stem", "class", "coords")
    if not append:
        touched = new.select("stem").distinct()
        replaced = old.where(F.col("class") == 1).join(touched, "stem", "left_anti")
        old = old.where(F.col("class") != 1).unionByName(replaced)
    return old.unionByName(new)
