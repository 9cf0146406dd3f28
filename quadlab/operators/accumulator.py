"""The detection report as a state that is updated, stored and merged without reading rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadlab.operators.metrics import classification_aggs, classification_rates
from quadlab.sources.versions import latest_version, read_version, write_version

#: Size of the quantile sketches: median and p95 are within RANK_ERROR of the wanted rank (normalised, with 99 % confidence); up to a few thousand values they are exact.
SKETCH_K, RANK_ERROR = 4096, 0.002
RECALLS, LOW_IOU, HIGH_ERROR = (50, 75, 90, 95, 99), (90, 95, 99), (10, 20, 50)
COUNTS = ["num_samples", "num_with_doc", "tp", "fp", "tn", "fn", "n_iou", "n_err", *[f"n_recall_{t}" for t in RECALLS], *[f"num_iou_lt_{t}" for t in LOW_IOU],
          *[f"num_err_gt_{t}" for t in HIGH_ERROR]]
SUMS, LEAST, GREATEST = ["sum_iou", "sum_err"], "corner_error_min_px", "corner_error_max_px"


def state_of(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The state of evaluated rows, one row per group: counts, sums, extremes, and quantile sketches of the IoU and of all corner errors.

    Partial states are merged within the aggregation, so one group may hold any share of the rows. Corner errors are four sketches, merged at the end, so that rows are not multiplied.
    """
    pos = F.col("has_doc")
    iou, err, e = F.when(pos, F.col("iou")), F.when(pos, F.col("err_mean")), F.when(pos, F.col("corner_errs"))
    corners = [F.kll_sketch_agg_double(F.get(e, F.lit(i)).cast("double"), F.lit(SKETCH_K)).alias(f"__e{i}") for i in range(4)]
    state = rows.groupBy(*by).agg(
        F.count("*").alias("num_samples"), F.count_if(pos).alias("num_with_doc"), *classification_aggs(pos, F.col("score")), F.count(iou).alias("n_iou"), F.count(err).alias("n_err"),
        *[F.count_if(iou >= t / 100.0).alias(f"n_recall_{t}") for t in RECALLS], *[F.count_if(iou < t / 100.0).alias(f"num_iou_lt_{t}") for t in LOW_IOU],
        *[F.count_if(err > t).alias(f"num_err_gt_{t}") for t in HIGH_ERROR], F.sum(iou).alias("sum_iou"), F.sum(err).alias("sum_err"),
        F.min(F.array_min(e)).alias(LEAST), F.max(F.array_max(e)).alias(GREATEST), F.kll_sketch_agg_double(iou.cast("double"), F.lit(SKETCH_K)).alias("iou_sketch"), *corners)
    all_ = F.col("__e0")
    for i in range(1, 4):
        all_ = F.kll_sketch_merge_double(all_, F.col(f"__e{i}"))
    return state.withColumn("err_sketch", all_).drop(*[f"__e{i}" for i in range(4)])


def merged(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per group of any number of states; no rows are read."""
    return states.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in COUNTS + SUMS], F.min(LEAST).alias(LEAST), F.max(GREATEST).alias(GREATEST),
        *[F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in ("iou_sketch", "err_sketch")])


def report(state: DataFrame) -> DataFrame:
    """The full detection report of each state; the columns of ``detection_metrics``. Median and p95 are values of the data within RANK_ERROR of their ranks."""
    def zero(c: Column, name: str) -> Column:
        return F.coalesce(c, F.lit(0.0)).alias(name)

    def quantile(sketch: str, p: float, name: str) -> Column:
        return zero(F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p))), name)

    keys = [c for c in state.columns if c not in {*COUNTS, *SUMS, LEAST, GREATEST, "iou_sketch", "err_sketch"}]
    return classification_rates(state).select(
        *keys, zero(F.try_divide("sum_iou", "n_iou"), "mean_iou"), quantile("iou_sketch", 0.5, "median_iou"), zero(F.try_divide("sum_err", "n_err"), "corner_error_px"),
        quantile("err_sketch", 0.95, "corner_error_p95_px"), zero(F.col(LEAST), LEAST), zero(F.col(GREATEST), GREATEST),
        *[zero(F.try_divide(f"n_recall_{t}", "n_iou"), f"recall_{t}") for t in RECALLS], *[f"num_iou_lt_{t}" for t in LOW_IOU], *[f"num_err_gt_{t}" for t in HIGH_ERROR],
        "num_samples", "num_with_doc", "cls_accuracy", "cls_precision", "cls_recall", "cls_f1")


class MetricAccumulator:
    """A stored state with reset, update, merge and compute.

    The state is a versioned table at ``path`` of one row per group; every step publishes a new version at once, so a step that fails leaves the last one. An update
    with a ``batch_id`` that is not after the stored one changes nothing. One writer at a time. ``reset`` starts anew; a report before the first update has no rows.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = (), keep: int = 8):
        self.spark, self.path, self.by, self.keep = spark, path, list(by), keep

    def state(self) -> DataFrame | None:
        return read_version(self.spark, self.path) if latest_version(self.spark, self.path) else None

    def _publish(self, new: DataFrame, batch_id: int | None) -> None:
        old = self.state()
        if old is not None:
            # a few rows: one per group
            last = old.agg(F.max("batch_id")).first()[0]
            if batch_id is not None and last is not None and batch_id <= last:
                return
            batch_id = last if batch_id is None else batch_id
            new = merged(old.drop("batch_id").unionByName(new), self.by)
        write_version(new.withColumn("batch_id", F.lit(batch_id).cast("bigint")), self.path, keep=self.keep)

    def reset(self) -> None:
        old = self.state()
        if old is not None:
            write_version(old.limit(0), self.path, keep=self.keep)

    def update(self, rows: DataFrame, batch_id: int | None = None) -> None:
        """Add evaluated rows, which are read once."""
        self._publish(state_of(rows, self.by), batch_id)

    def merge(self, other: MetricAccumulator) -> None:
        """Add what another accumulator has counted; its rows are not read."""
        state = other.state()
        if state is not None:
            self._publish(state.drop("batch_id"), None)

    def compute(self) -> DataFrame:
        state = self.state()
        if state is None:
            raise FileNotFoundError(f"{self.path} has no state yet")
        return report(state.drop("batch_id"))
