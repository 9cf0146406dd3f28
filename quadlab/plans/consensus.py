"""Vote between the label and three prediction sources of each sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quadlab.functions import names as N
from quadlab.functions.geometry import clip01, order_tlbr_angle
from quadlab.functions.fence import computed
from quadlab.functions.overlap import with_polygon_iou
from quadlab.operators.joins import join_labels, join_sources

PAIRS = [("gt", "teacher"), ("gt", "winner"), ("gt", "docaligner"),
         ("teacher", "winner"), ("teacher", "docaligner"), ("winner", "docaligner")]
QUADS = ["gt", "teacher", "winner", "docaligner"]


@dataclass(frozen=True)
class Thresholds:
    teacher_win_iou: float = 0.995
    agree_iou: float = 0.95
    gt_disagree_iou: float = 0.85
    drop_if_max_iou_below: float = 0.5


def candidates(samples: DataFrame, labels: DataFrame, preds: DataFrame) -> DataFrame:
    """One row per sample with its label, its sources and the six pair IoUs."""
    rows = join_sources(join_labels(samples, labels), preds)
    rows = rows.withColumn("gt", F.when(~F.col("is_negative"), clip01(F.col("gt"))))
    live = F.col("gt").isNotNull()
    rows = rows.withColumns({s: F.when(live, F.col(s)) for s in QUADS[1:]})
    return with_polygon_iou(rows, [(a, b, f"iou_{a}_{b}") for a, b in PAIRS], order="ccw",
                            valid={q: f"has_{q}" for q in QUADS})


def decide(cand: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Action per sample. Agreement between three sources is transitive, so its largest component is
    all three when two pairs agree, else the one agreeing pair; it always holds teacher or winner."""
    iou = {(a, b): F.col(f"iou_{a}_{b}") for a, b in PAIRS}

    def agree(a: str, b: str):
        return F.coalesce(iou[a, b] >= t.agree_iou, F.lit(False))
    with_teacher = agree("teacher", "winner") | agree("teacher", "docaligner")
    pick = F.when(with_teacher, F.lit("teacher")).when(agree("winner", "docaligner"), F.lit("winner"))
    gt_pick = F.when(F.col("pick") == "teacher", iou["gt", "teacher"]).otherwise(iou["gt", "winner"])
    n_polys = sum((F.col(f"has_{q}").cast("int") for q in QUADS), F.lit(0))
    far = F.col("pick").isNotNull() & (gt_pick <= t.gt_disagree_iou)
    action = (
        F.when(F.col("is_negative"), F.lit("keep_negative"))
        .when(F.col("gt").isNull(), F.lit("keep_missing_gt"))
        .when(iou["gt", "teacher"] >= t.teacher_win_iou, F.lit("replace_teacher_high_iou"))
        .when(far, F.concat(F.lit("replace_"), F.col("pick"), F.lit("_cluster")))
        .when(F.col("pick").isNotNull(), F.lit("keep_gt_cluster_not_far"))
        .when((F.col("n_polys") >= 3) & (F.col("max_iou") < t.drop_if_max_iou_below),
              F.when(F.col("protected"), F.lit("keep_gt_protected")).otherwise(F.lit("drop")))
        .otherwise(F.lit("keep_gt")))
    rows = cand.withColumns({
        "protected": N.is_protected(F.col("name")), "pick": pick, "n_polys": n_polys,
        "max_iou": F.greatest(F.lit(0.0), *[F.coalesce(v, F.lit(0.0)) for v in iou.values()])})
    rows = computed(rows, {"action": action})
    a = F.col("action")
    chosen = (F.when(a.isin("keep_negative", "drop"), F.lit("none")).when(a == "keep_missing_gt", F.lit("gt_missing"))
              .when(a == "replace_teacher_high_iou", F.lit("teacher"))
              .when(a.startswith("replace_"), F.col("pick")).otherwise(F.lit("gt")))
    reason = (F.when(a == "keep_negative", F.lit("negative")).when(a == "keep_missing_gt", F.lit("missing_gt_label"))
              .when(a == "replace_teacher_high_iou", F.lit(f"iou_gt_teacher>={t.teacher_win_iou}"))
              .when(a.startswith("replace_"), F.lit(f"cluster_{t.agree_iou}_gt_iou<={t.gt_disagree_iou}"))
              .when(a == "keep_gt_cluster_not_far", F.lit(f"cluster_{t.agree_iou}_gt_iou>{t.gt_disagree_iou}"))
              .when(a == "keep_gt_protected", F.lit("protected_no_drop"))
              .when(a == "drop", F.lit(f"max_pairwise_iou<{t.drop_if_max_iou_below}"))
              .otherwise(F.lit("default_keep_gt")))
    rows = rows.withColumns({"chosen_source": chosen, "reason": reason, "kept": a != "drop",
                             "max_pairwise_iou": F.when(F.col("n_polys") >= 2, F.col("max_iou"))})
    new = (F.when(F.col("chosen_source") == "teacher", F.col("teacher"))
           .when(F.col("chosen_source") == "winner", F.col("winner")))
    # chosen in a projection of its own: the order reads each coordinate many times
    rows = rows.withColumn("__new", new)
    rows = computed(rows, {"new_coords": F.when(F.col("__new").isNotNull(), clip01(order_tlbr_angle(F.col("__new"))))}).drop("__new")
    conf = {f"{s}_conf": F.when(F.col(f"has_{s}"), F.col(f"{s}_conf")) for s in QUADS[1:]}
    return rows.withColumns(conf).drop("pick", "max_iou")


def consensus_vote(samples: DataFrame, labels: DataFrame, preds: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return decide(candidates(samples, labels, preds), t)


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Counters of a vote; after ``min_total_guard`` those of the final membership."""
    a, neg = F.col("action"), F.col("is_negative")
    if "in_split" in decisions.columns:
        decisions = decisions.withColumn("kept", F.col("in_split"))
    return decisions.agg(
        F.count("*").alias("total"), F.count_if(~neg).alias("positives"), F.count_if(neg).alias("negatives"),
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"),
        F.count_if(F.col("new_coords").isNotNull()).alias("changed_labels"),
        F.count_if(F.col("kept") & F.col("protected") & ~neg & F.col("gt").isNotNull()).alias("kept_protected"),
        F.count_if(a == "keep_gt_protected").alias("dropped_attempted_protected"))


def min_total_guard(decisions: DataFrame, min_total: int) -> DataFrame:
    """Final split membership: when fewer than ``min_total`` rows are kept, no row is dropped.

    Only membership is restored; replaced labels and the recorded action stay.
    """
    kept = decisions.agg(F.count_if("kept").alias("n_kept"), F.lit(1).alias("__one"))
    return (decisions.withColumn("__one", F.lit(1)).join(kept, "__one").drop("__one")
            .withColumn("in_split", F.col("kept") | (F.col("n_kept") < min_total)))


def uncertain_kept(decisions: DataFrame, below: float = 0.5) -> DataFrame:
    """Kept rows whose best pair IoU is low and that have exactly one source besides the label."""
    n_sources = sum((F.col(f"has_{s}").cast("int") for s in QUADS[1:]), F.lit(0))
    return decisions.where(F.col("kept") & (F.col("max_pairwise_iou") < below) & (n_sources == 1))
