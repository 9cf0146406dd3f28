"""Label audits: against a teacher, and by geometry alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quadlab.functions import compare as C, geometry as G, names as N
from quadlab.functions.fence import computed
from quadlab.functions.overlap import with_polygon_iou
from quadlab.operators.joins import join_audit, join_labels, join_predictions, pick_image


def gt_vs_teacher(samples: DataFrame, labels: DataFrame, preds: DataFrame, source: str = "teacher",
                  min_conf: float = 0.0) -> DataFrame:
    """Label-teacher IoU of every positive. Rows without a valid label are blank; a missing or undetected
    teacher has IoU 0, and ``iou_at_min_conf`` only when no minimum confidence is asked."""
    rows = join_labels(samples.where(~F.col("is_negative")), labels)
    rows = join_predictions(rows.withColumn("gt", G.clip01(F.col("gt"))), preds, source)
    rows = with_polygon_iou(rows, [("gt", "pred", "iou_raw")], order="ccw", valid={"gt": "gt_ok"})
    ok = F.col("gt_ok")
    iou = F.coalesce("iou_raw", F.lit(0.0))
    at = iou if min_conf <= 0 else F.when(F.col("iou_raw").isNotNull() & (F.col("conf") >= min_conf), iou)
    return rows.select("split", "name", ok.cast("int").alias("gt_valid"),
                       F.when(ok, F.col("detected")).alias("teacher_detected"), F.when(ok, F.col("conf")).alias("teacher_conf"),
                       F.when(ok, iou).alias("iou"), F.when(ok, at).alias("iou_at_min_conf"), "has_row")


def gt_teacher_diff(rows: DataFrame, diff_iou: float = 0.9) -> DataFrame:
    return rows.where((F.col("gt_valid") == 1) & ((F.col("has_row") == 0) | (F.col("teacher_detected") != 1)
                                                  | (F.col("iou") < diff_iou)))


def teacher_audit(samples: DataFrame, labels: DataFrame, preds: DataFrame, sizes: DataFrame,
                  source: str = "teacher") -> DataFrame:
    """One audit row per sample. ``sizes``: name, w, h of the images that exist."""
    rows = join_labels(samples, labels).join(sizes.select("name", "w", "h"), "name", "left")
    rows = join_predictions(rows, preds, source)
    live = F.col("w").isNotNull() & ~F.col("is_negative")
    rows = rows.withColumns({
        "image_exists": F.col("w").isNotNull().cast("int"), "label_exists": F.col("gt_valid"),
        "gt": F.when(live, F.col("gt")), "detected": F.when(F.col("w").isNotNull(), F.col("detected")).otherwise(0),
        "conf": F.when(F.col("w").isNotNull(), F.col("conf")).otherwise(0.0)})
    rows = with_polygon_iou(rows, [("pred", "gt", "iou")], order="raw")
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    rows = computed(rows, {
        "gt_valid": F.col("gt").isNotNull().cast("int"),
        "gt_oob": F.coalesce(G.out_of_bounds(F.col("gt"), 0.02), F.lit(False)).cast("int"),
        "gt_area_ratio": G.valid_area(F.col("gt")) * w * h / F.greatest(F.lit(1.0), w * h),
        "err": C.corner_error_best_rotation(F.col("pred"), F.col("gt"), w, h),
        "rot": C.best_rotation(F.col("gt"), F.col("pred"), w, h)})
    return rows.select(
        "split", "name", "is_negative", "image_exists", "label_exists", F.col("detected").alias("teacher_detected"),
        F.col("conf").alias("teacher_conf"), "gt_valid", "gt_oob", "gt_area_ratio", "iou",
        F.col("err.mean").alias("err_mean_px"), F.col("err.max").alias("err_max_px"),
        F.col("rot.rot").alias("gt_rot_to_teacher"), F.col("rot.mean").alias("rot_err_px"), "w", "h", "gt", "stem")


def removal_reason(neg_conf: float = 0.95, very_high: float = 0.99, iou_med: float = 0.5, high: float = 0.95,
                   iou_low: float = 0.3) -> Column:
    hit, conf, iou = F.col("teacher_detected") == 1, F.col("teacher_conf"), F.col("iou")
    mismatch = hit & (((conf >= very_high) & (iou <= iou_med)) | ((conf >= high) & (iou <= iou_low)))
    positive = (F.when(F.col("gt_valid") == 0, F.lit("gt_invalid")).when(F.col("gt_oob") == 1, F.lit("gt_out_of_bounds"))
                .when(mismatch, F.lit("teacher_mismatch")))
    negative = F.when(hit & (conf >= neg_conf), F.lit("detected_on_negative"))
    return F.when(F.col("image_exists") == 1, F.when(F.col("is_negative"), negative).otherwise(positive))


def teacher_removals(audit: DataFrame) -> DataFrame:
    return audit.withColumn("reason", removal_reason()).where(F.col("reason").isNotNull())


def label_order_fix(audit: DataFrame, min_iou: float = 0.98, max_err_px: float = 10.0) -> DataFrame:
    """Labels whose corners start at the wrong one, with the rolled quad."""
    hit = (~F.col("is_negative") & (F.col("gt_oob") == 0) & (F.col("gt_valid") == 1) & (F.col("teacher_detected") == 1)
           & (F.col("iou") >= min_iou) & (F.col("gt_rot_to_teacher") != 0) & (F.col("rot_err_px") <= max_err_px))
    return audit.where(hit).withColumn("fixed", G.roll_left(F.col("gt"), F.col("gt_rot_to_teacher")))


def audit_table(audit: DataFrame) -> DataFrame:
    """The columns the outlier scan reads back from an audit file."""
    return audit.where(F.col("image_exists") == 1).select(
        "split", "name", (F.col("teacher_detected") == 1).alias("detected"), F.col("teacher_conf").alias("conf"), "iou",
        "err_mean_px", "err_max_px", "w", "h")


def gt_outliers(samples: DataFrame, labels: DataFrame, audit: DataFrame, border_norm: float = 0.005,
                border_px: float = 3.0, small_area: float = 0.05, small_dim: float = 0.15, fill: float = 0.55,
                ratio: float = 10.0, min_angle: float = 20.0, max_angle: float = 160.0, confirm_conf: float = 0.9,
                confirm_iou: float = 0.9) -> DataFrame:
    """Labels near the border, small or oddly shaped, and whether a confident teacher agrees with them."""
    rows = join_labels(samples.where(~F.col("is_negative")), labels, "inner")
    rows = computed(join_audit(rows, audit), {"o": G.order_ccw(F.col("gt"))})
    gt, o = F.col("gt"), F.col("o")
    b, angles = G.bbox(gt), G.interior_angles(o)
    rows = computed(rows, {
        "border_margin_norm": G.border_margin(gt),
        "border_margin_px": G.border_margin_px(gt, F.col("w").cast("double"), F.col("h").cast("double")),
        "area_ratio": G.valid_area(o), "bbox_area_ratio": b["area"], "bbox_w_norm": b["w"], "bbox_h_norm": b["h"],
        "min_dim_norm": b["min_dim"], "fill_ratio": G.fill_ratio(o), "self_intersect_raw": G.is_self_intersecting(gt),
        "convex": G.is_convex(o), "min_angle": F.least(*angles), "max_angle": F.greatest(*angles),
        "edge_ratio": G.edge_ratio(o)})
    rows = computed(rows, {
        "near_border": (F.col("border_margin_norm") <= border_norm)
        | F.coalesce(F.col("border_margin_px") <= border_px, F.lit(False)),
        "small": (F.col("area_ratio") <= small_area) | (F.col("min_dim_norm") <= small_dim),
        "weird": F.col("self_intersect_raw") | ~F.col("convex") | (F.col("fill_ratio") <= fill)
        | (F.col("edge_ratio") >= ratio) | (F.col("min_angle") <= min_angle) | (F.col("max_angle") >= max_angle)})
    rows = rows.where(F.col("near_border") | F.col("small") | F.col("weird"))
    match = (F.col("teacher_detected") & (F.col("teacher_conf") >= confirm_conf)
             & F.coalesce(F.col("teacher_iou") >= confirm_iou, F.lit(False)))
    return rows.withColumns({
        "flags": N.flag_list(border=F.col("near_border"), small=F.col("small"), weird=F.col("weird")),
        "teacher_confirmed": match, "teacher_status": F.when(match, "match").otherwise("no_match")}).drop("o", "gt", "stem")


def outlier_counts(outliers: DataFrame) -> DataFrame:
    return outliers.agg(F.count("*").alias("any"), *[F.count_if(c).alias(n) for n, c in (
        ("near_border", "near_border"), ("small", "small"), ("weird", "weird"), ("confirmed", "teacher_confirmed"))])


def small_boxes(labels: DataFrame, images: DataFrame, area: float = 0.05, side: float = 0.1,
                prefixes: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Labels with a small area or side that have an image, with the reasons as text."""
    rows = labels.where(F.col("coords").isNotNull())
    if prefixes:
        rows = rows.where(N.has_prefix(F.col("stem"), prefixes, ignore_case=False))
    if exclude:
        rows = rows.where(~N.has_prefix(F.col("stem"), exclude, ignore_case=False))
    q = F.col("coords")
    b = G.bbox(q)
    rows = rows.withColumns({"width": b["w"], "height": b["h"], "area": G.shoelace_area(q)})
    tests = [("area", area), ("width", side), ("height", side)]
    rows = rows.withColumn("reason", F.concat_ws(", ", *[
        F.when(F.col(c) < t, G.fixed(f"{c}=%.4f < {t}", F.col(c))) for c, t in tests]))
    rows = pick_image(rows.where(F.col("reason") != ""), images)
    name = F.concat("stem", "ext")
    return rows.select(name.alias("name"), "width", "height", "area", "reason", N.source_prefix(name).alias("prefix"))


def _exploded(rows: DataFrame, issues: Column) -> DataFrame:
    return rows.select("name", F.explode(issues).alias("issue")).withColumn("issue_type", N.issue_type(F.col("issue")))


def quad_issue_report(labels: DataFrame, images: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """One row per label issue of the given prefixes."""
    rows = labels.where(F.col("coords").isNotNull() & N.has_prefix(F.col("stem"), prefixes, ignore_case=False))
    rows = pick_image(rows, images).withColumn("name", F.concat("stem", "ext"))
    return _exploded(rows, G.quad_issues(F.col("coords")))


def deep_issue_report(labels: DataFrame, images: DataFrame, quality: DataFrame, hashes: DataFrame) -> DataFrame:
    """Corner order, edge contact, image quality and duplicates of every labelled image.

    ``quality``: stem, issues; ``hashes``: stem, hash. A duplicate names its hash and group size, not its
    members, so a group of any size stays one short text per row.
    """
    from quadlab.operators.metrics import duplicate_groups
    rows = pick_image(labels.where(F.col("coords").isNotNull()), images).withColumn("name", F.concat("stem", "ext"))
    q = F.col("coords")
    own = _exploded(rows, F.concat(G.corner_order_issues(q), G.edge_touch_issues(q)))
    looks = _exploded(rows.join(quality, "stem"), F.col("issues"))
    dup = duplicate_groups(rows.join(hashes, "stem").select("hash", "name"), "hash", "name")
    dup = dup.select("name", F.concat(F.lit("duplicate_image:"), "hash", F.lit(" x"), "group_size").alias("issue"),
                     F.lit("duplicate_image").alias("issue_type"))
    return own.unionByName(looks).unionByName(dup)
