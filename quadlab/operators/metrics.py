"""Aggregations over evaluated rows.

An evaluated row has: has_doc (boolean), gt, pred, score, iou, err_mean, err_max, corner_errs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadlab.functions import compare as C
from quadlab.functions.fence import computed
from quadlab.functions.overlap import bbox_iou, with_polygon_iou
from quadlab.operators.quantiles import aggregate, percentile


def evaluate_pairs(df: DataFrame, img_size: float = 224.0, exact_iou: bool = True, with_bbox: bool = False) -> DataFrame:
    """Add iou, err_mean, err_max and corner_errs (and iou_bbox) from the columns gt and pred."""
    gt, pred = F.col("gt"), F.col("pred")
    df = with_polygon_iou(df, [("pred", "gt", "iou")]) if exact_iou else df.withColumn("iou", bbox_iou(pred, gt))
    e = C.corner_errors(pred, gt, img_size)
    return computed(df, ({"iou_bbox": bbox_iou(pred, gt)} if with_bbox else {}) | {
        "corner_errs": F.when(gt.isNotNull() & pred.isNotNull(), F.array(*e)),
        "err_mean": C.mean4(e),
        "err_max": F.when(gt.isNotNull() & pred.isNotNull(), F.greatest(*e))})


def _rate(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def classification_aggs(label: Column, score: Column, threshold: float = 0.5) -> list[Column]:
    hit = score > threshold
    return [F.count_if(hit & label).alias("tp"), F.count_if(hit & ~label).alias("fp"),
            F.count_if(~hit & ~label).alias("tn"), F.count_if(~hit & label).alias("fn")]


def classification_rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, fp, tn, fn; 0 when a denominator is 0."""
    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    df = df.withColumns({
        "cls_accuracy": zero(F.try_divide(tp + tn, tp + fp + tn + fn)),
        "cls_precision": zero(F.try_divide(tp, tp + fp)),
        "cls_recall": zero(F.try_divide(tp, tp + fn))})
    p, r = F.col("cls_precision"), F.col("cls_recall")
    return df.withColumn("cls_f1", zero(F.try_divide(p * r * 2.0, p + r)))


def classification_metrics(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    aggs = classification_aggs(F.col("has_doc"), F.col("score"), threshold)
    return classification_rates(df.groupBy(*by).agg(*aggs))


def geometry_aggs(pos: Column) -> list[Column]:
    """Percentile-free part of the detection report, over positive rows."""
    iou, err = F.when(pos, F.col("iou")), F.when(pos, F.col("err_mean"))
    e = F.when(pos, F.col("corner_errs"))
    out = [F.avg(iou).alias("mean_iou"), F.avg(err).alias("corner_error_px"),
           F.min(F.array_min(e)).alias("corner_error_min_px"), F.max(F.array_max(e)).alias("corner_error_max_px")]
    out += [_rate(F.when(pos, F.col("iou") >= t / 100.0)).alias(f"recall_{t}") for t in (50, 75, 90, 95, 99)]
    out = [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(out, [
        "mean_iou", "corner_error_px", "corner_error_min_px", "corner_error_max_px",
        "recall_50", "recall_75", "recall_90", "recall_95", "recall_99"])]
    out += [F.count_if(pos & (F.col("iou") < t / 100.0)).alias(f"num_iou_lt_{t}") for t in (90, 95, 99)]
    out += [F.count_if(pos & (F.col("err_mean") > t)).alias(f"num_err_gt_{t}") for t in (10, 20, 50)]
    out += [F.count("*").alias("num_samples"), F.count_if(pos).alias("num_with_doc")]
    return out


def detection_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The full report: IoU, corner error, recall, outlier counts and classification, one row per group."""
    pos = F.col("has_doc")
    aggs = geometry_aggs(pos) + classification_aggs(pos, F.col("score"))
    errs = [F.when(pos, F.get("corner_errs", F.lit(i))) for i in range(4)]
    specs = [percentile("median_iou", 0.5, F.when(pos, F.col("iou"))), percentile("corner_error_p95_px", 0.95, *errs)]
    rows = aggregate(df, by, aggs, specs, inputs=["has_doc", "iou", "err_mean", "corner_errs", "score"])
    out = classification_rates(rows).drop("tp", "fp", "tn", "fn")
    return out.fillna(0.0, ["median_iou", "corner_error_p95_px"])


def iou_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    iou = F.col("iou")
    aggs = [F.count("iou").alias("n"), F.avg("iou").alias("mean_iou"),
            _rate(iou < 0.5).alias("frac_lt_50"), _rate(iou < 0.1).alias("frac_lt_10"),
            _rate(iou >= 0.9).alias("recall_90"), _rate(iou >= 0.95).alias("recall_95"),
            F.avg("err_mean").alias("corner_err_mean_px")]
    specs = [percentile("median_iou", 0.5, "iou"), percentile("p01_iou", 0.01, "iou"), percentile("p05_iou", 0.05, "iou"),
             percentile("corner_err_p95_px", 0.95, "err_mean")]
    return aggregate(df, by, aggs, specs, inputs=["iou", "err_mean"]).fillna(0.0)


def percentile_profile(df: DataFrame, value: str = "iou", points: Sequence[int] = (1, 5, 10, 25, 50, 75, 95),
                       by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")]
    return aggregate(df, by, aggs, [percentile(f"p{p:02d}", p / 100.0, value) for p in points], inputs=[value])


def extended_metrics(df: DataFrame, by: Sequence[str] = (), img_size: float = 224.0) -> DataFrame:
    """Training-time variant: bounding-box IoU, L1 error, score accuracy at >= 0.5."""
    pos = F.col("has_doc")
    df = df.withColumns({"iou_bb": F.when(pos, bbox_iou(F.col("pred"), F.col("gt"), 1e-9)),
                         "l1": F.when(pos, C.coord_error_l1(F.col("pred"), F.col("gt"), img_size))})
    aggs = [F.count_if(pos).alias("pos_count"), F.count_if(~pos).alias("neg_count"),
            F.coalesce(F.avg("iou_bb"), F.lit(0.0)).alias("mean_iou"), F.coalesce(F.avg("l1"), F.lit(999.0)).alias("mean_err"),
            _rate((F.col("score") >= 0.5) == pos).alias("score_acc"),
            F.coalesce(F.avg(F.when(pos, F.col("score"))), F.lit(0.0)).alias("score_pos_mean"),
            F.coalesce(F.avg(F.when(~pos, F.col("score"))), F.lit(0.0)).alias("score_neg_mean")]
    tail = (0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")
    specs = [percentile(f"{n}_{t}", p, c) for c, t in (("iou_bb", "iou"), ("l1", "err")) for p, n in tail]
    return (aggregate(df, by, aggs, specs, inputs=["has_doc", "iou_bb", "l1", "score"]).fillna(0.0, [f"{n}_iou" for _, n in tail])
            .fillna(999.0, [f"{n}_err" for _, n in tail]))


def split_summary(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{p}_{n}") for c, p in (("iou", "iou"), ("err_mean", "err"))
          for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))],
        F.count_if(F.col("iou") < 0.9).alias("n_iou_lt_90"), F.count_if(F.col("iou") < 0.8).alias("n_iou_lt_80"))


def category_distribution(df: DataFrame, category: str = "category") -> DataFrame:
    """Count and percent per category. The window runs over the few category rows only."""
    c = df.groupBy(category).agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()))


def iou_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    iou = F.col("iou")
    aggs = [F.count("iou").alias("n"), F.avg("iou").alias("mean"), F.min("iou").alias("min"), F.max("iou").alias("max"),
            F.stddev_pop("iou").alias("std"), *[F.count_if(iou >= t / 100).alias(f"n_ge_{t}") for t in (50, 70, 90)]]
    return aggregate(df, by, aggs, [percentile("median", 0.5, "iou")], inputs=["iou"])


def issue_counts(issues: DataFrame, name: str = "name", issue: str = "issue_type") -> DataFrame:
    """Occurrences and distinct affected names per issue type.

    Distinct names are grouped before counting, so a hot issue type is spread over many tasks.
    """
    return (issues.groupBy(issue, name).agg(F.count("*").alias("k"))
            .groupBy(issue).agg(F.sum("k").alias("n_issues"), F.count("*").alias("n_names")))


def duplicate_groups(df: DataFrame, key: str, name: str) -> DataFrame:
    """Members of every key with more than one row, with the group size.

    Sizes come from a pre-aggregated count joined back, not from a window or a member list, so a
    group holding a large share of the rows costs no single task.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("group_size")).where(F.col("group_size") > 1)
    return df.join(sizes, key).select(key, name, "group_size")


def iou_histogram(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Disjoint bands and the cumulative counts at their lower ends, with percent of all rows."""
    iou = F.col("iou")
    n = F.count("iou")
    bands = {"b99": iou >= 0.99, "b98": (iou >= 0.98) & (iou < 0.99), "b97": (iou >= 0.97) & (iou < 0.98),
             "b95": (iou >= 0.95) & (iou < 0.97), "blow": iou < 0.95}
    cum = {f"ge{t}": iou >= t / 100 for t in (99, 98, 97, 95)}
    return df.groupBy(*by).agg(
        n.alias("n"), *[F.count_if(c).alias(k) for k, c in {**bands, **cum}.items()],
        *[(F.count_if(c) * 100.0 / n).alias(f"{k}_pct") for k, c in cum.items()])


def review_dashboard(df: DataFrame) -> DataFrame:
    """Quality of positive, not discarded rows; ``iou_b`` is a second model and may be null."""
    live = F.col("has_doc") & ~F.col("discarded")

    def block(c: str, tag: str) -> list[Column]:
        v = F.when(live, F.col(c))
        return [F.avg(v).alias(f"mean_iou{tag}"), (_rate(v >= 0.95) * 100.0).alias(f"recall_95{tag}"),
                (_rate(v >= 0.90) * 100.0).alias(f"recall_90{tag}"), F.count_if(v < 0.5).alias(f"failed{tag}")]
    err = F.when(live, F.col("err_mean"))
    out = df.agg(F.count_if(live).alias("n_positive"), *block("iou", ""), F.avg(err).alias("mean_err"),
                 F.count_if(err > 10).alias("high_error"), *block("iou_b", "_b"),
                 F.count_if(F.col("modified")).alias("n_modified"), F.count_if(F.col("discarded")).alias("n_discarded"))
    return out.withColumn("delta_mean_iou", F.col("mean_iou_b") - F.col("mean_iou"))


def latency_summary(df: DataFrame, by: Sequence[str] = ("model",), value: str = "ms") -> DataFrame:
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean_ms")]
    return aggregate(df, by, aggs, [percentile("p50_ms", 0.5, value), percentile("p95_ms", 0.95, value)], inputs=[value])


def negative_ratio(samples: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    neg = F.count_if("is_negative")
    pos = F.count_if(~F.col("is_negative"))
    return samples.groupBy(*by).agg(
        pos.alias("n_pos"), neg.alias("n_neg"), (neg / F.greatest(pos, F.lit(1))).alias("neg_ratio"))


def confidence_summary(preds: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    conf = F.when(F.col("detected") == 1, F.col("conf"))
    aggs = [F.count("*").alias("processed"), F.count(conf).alias("n_detected"),
            F.coalesce(F.avg(conf), F.lit(0.0)).alias("conf_mean")]
    return aggregate(preds, by, aggs, [percentile("conf_p50", 0.5, conf), percentile("conf_p95", 0.95, conf)],
                     inputs=["detected", "conf"]).fillna(0.0)


def worst_case_across_datasets(df: DataFrame) -> DataFrame:
    """Least mean IoU of each model over its data sets, ranked; (model, dataset, mean_iou) is one row per run."""
    worst = df.groupBy("model").agg(F.min("mean_iou").alias("worst_mean_iou"), F.count("*").alias("n_datasets"))
    return worst.withColumn("rank", F.rank().over(Window.orderBy(F.desc("worst_mean_iou"))))


def split_profile(samples: DataFrame) -> DataFrame:
    """Positives, negatives and listed outliers per split; needs ``is_outlier`` (0/1)."""
    return samples.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_negative")).alias("positives"),
        F.count_if("is_negative").alias("negatives"),
        F.count_if((F.col("is_outlier") == 1) & ~F.col("is_negative")).alias("outliers"))


def status_counts(df: DataFrame, status: str = "status", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, status).agg(F.count("*").alias("n"))


def target_check(metrics: DataFrame, min_iou: float = 0.99, max_err: float = 1.0) -> DataFrame:
    iou_ok, err_ok = F.col("mean_iou") >= min_iou, F.col("corner_error_px") <= max_err
    return metrics.withColumns({"iou_ok": iou_ok.cast("int"), "err_ok": err_ok.cast("int"),
                                "passed": (iou_ok & err_ok).cast("int")})
