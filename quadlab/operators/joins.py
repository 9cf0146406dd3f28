"""Equi-joins between samples, labels, predictions, audits and review state.

No join forces a broadcast: build sides grow with the data, so Spark chooses by measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quadlab.functions import names as N
from quadlab.functions.overlap import with_polygon_iou
from quadlab.schema import IMAGE_EXTENSIONS, SOURCES

KEY = ["split", "name"]


def join_labels(samples: DataFrame, labels: DataFrame, how: str = "left", label_col: str = "gt") -> DataFrame:
    """Add the label quad by stem, and ``gt_valid``."""
    lab = labels.select("stem", F.col("coords").alias(label_col))
    if how == "inner":
        lab = lab.where(F.col(label_col).isNotNull())
    return samples.join(lab, "stem", how).withColumn("gt_valid", F.col(label_col).isNotNull().cast("int"))


def join_predictions(samples: DataFrame, preds: DataFrame, source: str | None = None, out: str = "pred") -> DataFrame:
    """Add one source's prediction; a missing row counts as undetected with confidence 0."""
    p = preds.where(F.col("source") == source) if source else preds
    p = p.select(*KEY, "detected", "conf", F.when(F.col("detected") == 1, F.col("coords")).alias(out),
                 F.lit(1).alias("has_row"))
    return samples.join(p, KEY, "left").withColumns({
        "detected": F.coalesce("detected", F.lit(0)), "conf": F.coalesce("conf", F.lit(0.0)),
        "has_row": F.coalesce("has_row", F.lit(0))})


def pivot_sources(preds: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """One row per sample with ``<source>`` and ``<source>_conf``, null when undetected; one shuffle for all sources."""
    aggs = []
    for s in sources:
        hit = (F.col("source") == s) & (F.col("detected") == 1)
        aggs += [F.max(F.when(hit, F.struct("conf", "coords"))).alias(f"__{s}")]
    wide = preds.groupBy(*KEY).agg(*aggs)
    cols = [c for s in sources for c in (F.col(f"__{s}.coords").alias(s), F.col(f"__{s}.conf").alias(f"{s}_conf"))]
    return wide.select(*KEY, *cols)


def join_sources(samples: DataFrame, preds: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    return samples.join(pivot_sources(preds, sources), KEY, "left")


def source_pairs(preds: DataFrame) -> DataFrame:
    """Each unordered pair of detected sources of one image, source_a < source_b, at most one row per source.

    The few sources of an image are gathered in one shuffle and paired in the row.
    """
    found = F.sort_array(F.collect_set(F.struct("source", "coords")))
    rows = preds.where(F.col("detected") == 1).groupBy(*KEY).agg(found.alias("__all"))
    # of equal sources the greatest coordinates stay
    last = F.filter("__all", lambda x, i: F.coalesce(F.get("__all", i + 1)["source"] != x["source"], F.lit(True)))
    rows = rows.select(*KEY, last.alias("__one"))

    def pairs(x: Column, i: Column) -> Column:
        after = F.slice("__one", i + 2, F.size("__one"))
        return F.transform(after, lambda y: F.struct(x["source"].alias("source_a"), x["coords"].alias("a"),
                                                     y["source"].alias("source_b"), y["coords"].alias("b")))
    return rows.select(*KEY, F.inline(F.flatten(F.transform("__one", pairs))))


def pairwise_iou(preds: DataFrame) -> DataFrame:
    return with_polygon_iou(source_pairs(preds), [("a", "b", "iou")], order="ccw").drop("a", "b")


def join_audit(flagged: DataFrame, audit: DataFrame) -> DataFrame:
    """Optional size, confidence, IoU and errors of the audit row."""
    a = audit.select(*KEY, F.col("detected").alias("teacher_detected"), F.col("conf").alias("teacher_conf"),
                     F.col("iou").alias("teacher_iou"), "err_mean_px", "err_max_px", "w", "h")
    return flagged.join(a, KEY, "left").withColumns({
        "teacher_detected": F.coalesce(F.col("teacher_detected").cast("boolean"), F.lit(False)),
        "teacher_conf": F.coalesce("teacher_conf", F.lit(0.0))})


def join_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select(*KEY, F.col("iou").alias("iou_old"))
    n = new.select(*KEY, F.col("iou").alias("iou_new"))
    return o.join(n, KEY)


def without_names(samples: DataFrame, names: DataFrame) -> DataFrame:
    return samples.join(names.select("name").distinct(), "name", "left_anti")


def without_name_variants(samples: DataFrame, names: DataFrame) -> DataFrame:
    """Anti join on the base name, so ``images/x`` and ``x`` are the same sample."""
    keys = names.select(N.base_name(F.col("name")).alias("__base")).distinct()
    return (samples.withColumn("__base", N.base_name(F.col("name")))
            .join(keys, "__base", "left_anti").drop("__base"))


def only_names(samples: DataFrame, names: DataFrame) -> DataFrame:
    return samples.join(names.select("name"), "name", "left_semi")


def with_membership(samples: DataFrame, names: DataFrame, out: str) -> DataFrame:
    n = names.select("name").distinct().withColumn("__hit", F.lit(1))
    return (samples.join(n, "name", "left")
            .withColumn(out, F.coalesce("__hit", F.lit(0))).drop("__hit"))


def extension_rank(ext: Column, order: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    rank = None
    for i, e in enumerate(order):
        rank = F.when(ext == e, F.lit(i)) if rank is None else rank.when(ext == e, F.lit(i))
    return rank


def pick_image(labels: DataFrame, images: DataFrame, key: str = "stem", order: Sequence[str] = IMAGE_EXTENSIONS,
               dirs: Sequence[str] | None = None) -> DataFrame:
    """Join each label with its image: first directory in ``dirs``, then first extension in ``order``."""
    rank = extension_rank(F.col("ext"), order)
    if dirs is not None:
        rank = F.struct(extension_rank(F.col("dir"), dirs).alias("d"), rank.alias("e"))
    best = images.where(F.col("ext").isin(list(order))).groupBy(key).agg(F.min_by("ext", rank).alias("ext"))
    return labels.join(best, key)


def deleted_overlays(index: DataFrame, existing: DataFrame) -> DataFrame:
    """Index rows whose overlay file is gone."""
    return index.join(existing.select("overlay_rel"), "overlay_rel", "left_anti")


def review_rows(events: DataFrame) -> DataFrame:
    """One row per event in the columns of the stored review state: the last gate and edit so far, with their places, and the number of edits."""
    gate = F.col("action").isin("discard", "undiscard")
    edit = F.col("action") == "modify"
    return events.select(
        "name", F.when(gate, F.col("action")).alias("gate"), F.when(gate, F.col("seq")).alias("gate_seq"), F.when(edit, F.col("coords")).alias("edited"),
        F.when(edit, F.col("seq")).alias("edit_seq"), edit.cast("bigint").alias("n_edits"))


def folded(rows: DataFrame) -> DataFrame:
    """Rows of the review state, one per name; folds of folds are folds, in any order."""
    return rows.groupBy("name").agg(F.max_by("gate", "gate_seq").alias("gate"), F.max("gate_seq").alias("gate_seq"), F.max_by("edited", "edit_seq").alias("edited"),
                                    F.max("edit_seq").alias("edit_seq"), F.sum("n_edits").alias("n_edits"))


def review_state(state: DataFrame) -> DataFrame:
    return state.select("name", F.coalesce(F.col("gate") == "discard", F.lit(False)).alias("discarded"), "edited", "n_edits")


def fold_events(events: DataFrame) -> DataFrame:
    """Per name: whether the last discard/undiscard leaves it discarded, and its last edit."""
    return review_state(folded(review_rows(events)))


def accepted_predictions(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """``events`` with each ``accept`` turned into the ``modify`` that it stands for: the prediction as it was when it was accepted.

    ``predictions`` has every version of every prediction: ``name, version, seq, coords``. The one that counts is the last before the event, by ``seq`` and then version; what
    is predicted later changes nothing, and an accept without a prediction before it is no edit. Of the accepts of a name only the last with a prediction
    before it is looked up (edits before it are overruled anyway, but still counted), so the join has one row per name on its side.
    """
    first = predictions.where("coords is not null").groupBy("name").agg(F.min("seq").alias("__from"))
    accepts = events.where("action = 'accept'").join(first, "name").where(F.col("__from") < F.col("seq")).select("name", "seq")
    last = accepts.groupBy("name").agg(F.max("seq").alias("__at"))
    shown = (predictions.where("coords is not null").join(last, "name").where(F.col("seq") < F.col("__at"))
             .groupBy("name", "__at").agg(F.max_by("coords", F.struct("seq", "version")).alias("coords")))
    edits = (accepts.join(shown, "name", "left").select("name", "seq", F.when(F.col("seq") == F.col("__at"), F.col("coords")).alias("coords")))
    return (events.where("action is null or action <> 'accept'").select("name", "seq", "action", "coords")
            .unionByName(edits.select("name", "seq", F.lit("modify").alias("action"), "coords")))


def effective_labels(labelled: DataFrame, state: DataFrame) -> DataFrame:
    """Label after review: the last edit when there is one; edits of discarded rows are not applied."""
    s = state.select("name", "discarded", "edited")
    return (labelled.join(s, "name", "left")
            .withColumn("discarded", F.coalesce("discarded", F.lit(False)))
            .withColumn("modified", F.col("edited").isNotNull() & ~F.col("discarded"))
            .withColumn("effective", F.when(F.col("modified"), F.col("edited")).otherwise(F.col("gt"))))


def compare_sources(labelled: DataFrame, preds: DataFrame, a: str, b: str) -> DataFrame:
    """IoU of two sources against the same label, and b minus a; a missing source has IoU 0."""
    wide = labelled.join(pivot_sources(preds, [a, b]), KEY, "left")
    out = with_polygon_iou(wide, [("gt", a, "iou_a"), ("gt", b, "iou_b")], order="raw")
    return (out.withColumns({"iou_a": F.coalesce("iou_a", F.lit(0.0)), "iou_b": F.coalesce("iou_b", F.lit(0.0))})
            .withColumn("delta", F.col("iou_b") - F.col("iou_a")).drop(a, b))


def label_diff(before: DataFrame, after: DataFrame, decisions: DataFrame) -> DataFrame:
    """Old and new label of each changed name with its decision, and the IoU between the two."""
    b = before.select("name", F.col("coords").alias("old"))
    a = after.select("name", F.col("coords").alias("new"))
    rows = decisions.join(b, "name").join(a, "name")
    return with_polygon_iou(rows, [("old", "new", "iou_old_new")], order="ccw")


def paired_runs(runs: DataFrame, left: str, right: str) -> DataFrame:
    """Same model in two precisions: change of mean IoU and latency ratio, from (model, precision, mean_iou, ms)."""
    def side(p: str, tag: str) -> list[Column]:
        hit = F.col("precision") == p
        return [F.max(F.when(hit, F.col("mean_iou"))).alias(f"iou_{tag}"),
                F.max(F.when(hit, F.col("ms"))).alias(f"ms_{tag}")]
    wide = runs.groupBy("model").agg(*side(left, "a"), *side(right, "b"))
    return (wide.where(F.col("iou_a").isNotNull() & F.col("iou_b").isNotNull())
            .withColumn("delta_iou", F.col("iou_b") - F.col("iou_a"))
            .withColumn("speedup", F.try_divide("ms_a", "ms_b")))
