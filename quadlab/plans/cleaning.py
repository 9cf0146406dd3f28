"""Evaluation of a source against labels, mining, and rebuilding splits from the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quadlab.checkpoints import cut
from quadlab.functions import compare as C, geometry as G, names as N
from quadlab.functions.overlap import bbox_iou
from quadlab.operators import ranking as R, sampling as S
from quadlab.operators.joins import join_labels, join_predictions, join_runs
from quadlab.operators.metrics import evaluate_pairs, negative_ratio


def evaluated(samples: DataFrame, labels: DataFrame, preds: DataFrame, source: str, img_size: float = 224.0,
              exact_iou: bool = True) -> DataFrame:
    """Every sample with label, prediction and comparison.

    A model always answers, so an undetected or missing prediction is the zero quad with its score;
    positives without a label count as having no document.
    """
    rows = join_predictions(join_labels(samples, labels), preds, source)
    has_doc = ~F.col("is_negative") & F.col("gt").isNotNull()
    zero = F.array_repeat(F.lit(0.0), 8)
    rows = rows.withColumns({
        "has_doc": has_doc, "score": F.col("conf") * F.col("detected"),
        "gt": F.when(has_doc, F.col("gt")), "pred": F.coalesce("pred", zero)})
    return evaluate_pairs(rows, img_size, exact_iou)


def full_evaluation(samples: DataFrame, labels: DataFrame, preds: DataFrame, source: str) -> DataFrame:
    """split, name, iou, err_mean, err_max, score of all positives."""
    rows = evaluated(samples.where(~F.col("is_negative")), labels, preds, source).where("has_doc")
    return rows.select("split", "name", "iou", "err_mean", "err_max",
                       C.run_score(F.col("iou"), F.col("err_mean")).alias("score"))


def rounded_evals(evals: DataFrame) -> DataFrame:
    """The values the evaluation file keeps; later thresholds see these."""
    return evals.withColumns({"iou": F.round("iou", 6), "err_mean": F.round("err_mean", 2),
                              "err_max": F.round("err_max", 2), "score": F.round("score", 4)})


def in_evaluation_order(evals: DataFrame) -> DataFrame:
    """The order of the evaluation file: greatest IoU first, then by name."""
    return evals.orderBy(F.desc("iou"), "name")


def worst_rows(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` positives of largest error with both IoU kinds and the model's own score."""
    worst = rows.where("has_doc").orderBy(F.desc("err_mean"), "name").limit(n)
    return worst.select("split", "name", "iou", bbox_iou(F.col("pred"), F.col("gt")).alias("iou_bbox"), "err_mean", "err_max", "score")


def worst_cases(evals: DataFrame, min_err: float = 0.0, n: int = 0, by_iou: bool = False) -> DataFrame:
    rows = evals.where(F.col("err_mean") >= min_err) if min_err > 0 else evals
    rows = rows.orderBy(F.asc("iou") if by_iou else F.desc("err_mean"), "name")
    return rows.limit(n) if n else rows


def find_outliers(evals: DataFrame, threshold: float = 10.0) -> DataFrame:
    return evals.where(F.col("err_mean") >= threshold).orderBy(F.desc("err_mean"), "name")


def mine_hard_examples(rows: DataFrame, iou_below: float = 0.9, err_above: float | None = None, top_k: int = 0,
                       score_threshold: float = 0.5) -> DataFrame:
    """Low-IoU or high-error positives (or the ``top_k`` lowest), then false positives, then false negatives."""
    pos, score = F.col("has_doc"), F.col("score")
    fp, fn = ~pos & (score >= score_threshold), pos & (score < score_threshold)
    if top_k:
        rows = rows.select("name", "has_doc", "iou", "score")
        hard = R.lowest_k(rows.where(pos), top_k)
        return R.ordered_union_distinct([(hard, F.col("iou")), (rows.where(fp), -score), (rows.where(fn), score)])
    low = F.col("iou") < iou_below
    if err_above is not None:
        low = low | (F.col("err_mean") > err_above)
    return R.ordered_distinct(rows, [(pos & low, F.col("iou")), (fp, -score), (fn, score)])


def clean_splits_by_target(rows: DataFrame, outliers: DataFrame, target: float = 0.99, max_drop: float = 0.3,
                           train_drop: float | None = None, train_err_px: float | None = None) -> DataFrame:
    """Keep or remove each sample, with the reason.

    Listed outliers and insane labels go first; then the fewest lowest-IoU validation rows until their
    mean reaches the target, and the training rows with the largest error: the share ``train_drop``, by default
    the share that validation really lost. Negatives stay.
    """
    listed = outliers.select("name").distinct().withColumn("listed", F.lit(True))
    rows = rows.join(listed, "name", "left").withColumn("reason", F.when(F.col("has_doc"), (
        F.when(F.col("listed"), F.lit("outliers.txt")).when(~G.quad_is_sane(F.col("gt")), F.lit("label_invalid")))))
    # the cuts below read the rows several times
    slim = cut(rows.select("split", "name", "has_doc", "iou", "err_mean", "reason"))
    sound = slim.where(F.col("has_doc") & F.col("reason").isNull())
    val = R.drop_min_until_mean(sound.where(F.col("split") == "val"), target, max_drop)
    val = val.withColumn("reason", F.when(F.col("dropped"), F.lit("low_iou_to_hit_target")))
    if train_drop is None:
        val = cut(val)
        lost, n = val.agg(F.count_if("dropped"), F.count("*")).first()
        train_drop = lost / n if n else 0.0
    train = R.drop_top_fraction(sound.where(F.col("split") != "val"), train_drop, threshold=train_err_px)
    train = train.withColumn("reason", F.when(F.col("dropped"), F.lit("large_error")))
    rest = slim.where(~F.col("has_doc") | F.col("reason").isNotNull())
    out = S.union_all(*[d.select("split", "name", "has_doc", "reason") for d in (val, train, rest)])
    return out.withColumn("kept", F.col("reason").isNull())


def clean_positives(evals: DataFrame, threshold: float = 0.99, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    return evals.where((F.col("iou") >= threshold) & F.col("split").isin(list(splits))
                       & ~N.is_negative(F.col("name"))).select("split", "name")


def clean_splits_by_threshold(evals: DataFrame, samples: DataFrame, threshold: float = 0.99, seed: int = 1337) -> DataFrame:
    """Clean positives plus negatives sampled at each split's original ratio."""
    pos = clean_positives(evals, threshold)
    neg = S.sample_negatives(samples, pos, negative_ratio(samples), seed).select("split", "name")
    return pos.withColumn("is_negative", F.lit(False)).unionByName(neg.withColumn("is_negative", F.lit(True)))


def expansion_candidates(old: DataFrame, new: DataFrame, old_max: float = 0.99, new_min: float = 0.98,
                         splits: Sequence[str] = ("train", "val"), negatives: bool = False) -> DataFrame:
    rows = join_runs(old, new).where((F.col("iou_old") < old_max) & (F.col("iou_new") >= new_min)
                                     & F.col("split").isin(list(splits)))
    return rows if negatives else rows.where(~N.is_negative(F.col("name")))


def iou_range_candidates(rows: DataFrame, lo: float, hi: float) -> DataFrame:
    hit = rows.where(F.col("iou").isNotNull() & (F.col("iou") >= lo) & (F.col("iou") < hi))
    return hit.orderBy(F.asc("iou"), (F.col("teacher_detected") != 0).cast("int"), "name")


def self_training_round(old: DataFrame, new: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Training set of the next round: clean rows of the old evaluation, then the candidates of the new one."""
    clean = clean_positives(old, threshold).withColumn("origin", F.lit("clean"))
    found = expansion_candidates(old, new, threshold).select("split", "name").withColumn("origin", F.lit("candidate"))
    return clean.unionByName(found)


def round_progress(old: DataFrame, new: DataFrame, expanded: DataFrame) -> DataFrame:
    """One row per split: clean size, candidates, expanded size and mean IoU before and after."""
    sizes = expanded.groupBy("split").agg(
        F.count_if(F.col("origin") == "clean").alias("n_clean"),
        F.count_if(F.col("origin") == "candidate").alias("n_candidates"), F.count("*").alias("n_expanded"))
    before = old.groupBy("split").agg(F.count("*").alias("n_evaluated"), F.avg("iou").alias("mean_iou_old"))
    after = new.groupBy("split").agg(F.avg("iou").alias("mean_iou_new"))
    return before.join(after, "split").join(sizes, "split", "left").fillna(0)


