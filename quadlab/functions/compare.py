"""Comparison of two quads and bands over the results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quadlab.functions import geometry as G


def corner_errors(a: Column, b: Column, w=1.0, h=None) -> list[Column]:
    """Distance per corner after scaling x by ``w`` and y by ``h`` (``w`` when not given)."""
    h = w if h is None else h
    out = []
    for ax, ay, bx, by in zip(G.xs(a), G.ys(a), G.xs(b), G.ys(b)):
        dx, dy = (ax - bx) * w, (ay - by) * h
        out.append(F.sqrt(dx * dx + dy * dy))
    return out


def mean4(parts: list[Column]) -> Column:
    return (parts[0] + parts[1] + parts[2] + parts[3]) / F.lit(4.0)


def corner_error_mean(a: Column, b: Column, img_size: float = 224.0) -> Column:
    return mean4(corner_errors(a, b, img_size))


def corner_error_max(a: Column, b: Column, img_size: float = 224.0) -> Column:
    return F.greatest(*corner_errors(a, b, img_size))


def coord_error_l1(a: Column, b: Column, img_size: float = 224.0) -> Column:
    total = F.lit(0.0)
    for i in range(8):
        total = total + F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i)))
    return total * F.lit(img_size / 8.0)


def best_rotation(gt: Column, pred: Column, w=1.0, h=None) -> Column:
    """Left-roll of ``gt`` closest to ``pred``: struct(total, rot, mean, max); the first roll wins ties."""
    h = w if h is None else h
    gx, gy, px, py = G.xs(gt), G.ys(gt), G.xs(pred), G.ys(pred)
    rolls = []
    for rot in range(4):
        e = []
        for i in range(4):
            j = (i + rot) % 4
            dx, dy = (gx[j] - px[i]) * w, (gy[j] - py[i]) * h
            e.append(F.sqrt(dx * dx + dy * dy))
        total = e[0] + e[1] + e[2] + e[3]
        rolls.append(F.struct(total.alias("total"), F.lit(rot).alias("rot"),
                              (total / F.lit(4.0)).alias("mean"), F.greatest(*e).alias("max")))
    return F.when(gt.isNotNull() & pred.isNotNull(), F.array_min(F.array(*rolls)))


def corner_error_best_rotation(pred: Column, gt: Column, w=1.0, h=None) -> Column:
    """Least total corner error over the cyclic shifts of ``pred``: struct(total, rot, mean, max)."""
    return best_rotation(pred, gt, w, h)


def corner_distance_diag(gt: Column, pred: Column, w: Column, h: Column) -> dict[str, Column]:
    """Corner distances as a share of the image diagonal."""
    diag = F.sqrt(w * w + h * h)
    d = [F.try_divide(e, diag) for e in corner_errors(gt, pred, w, h)]
    return {"corners": F.array(*d), "max": F.greatest(*d), "avg": mean4(d)}


def error_category(iou: Column, max_dist: Column, has_gt: Column, has_pred: Column) -> Column:
    return (
        F.when(~has_gt & ~has_pred, F.lit("true_negative"))
        .when(~has_gt, F.lit("false_positive"))
        .when(~has_pred, F.lit("false_negative"))
        .when(iou >= 0.9, F.lit("excellent"))
        .when(iou >= 0.7, F.lit("good"))
        .when((iou >= 0.5) & (max_dist > 0.15), F.lit("corner_outlier"))
        .when(iou >= 0.5, F.lit("moderate"))
        .when(iou >= 0.3, F.lit("poor"))
        .when(iou > 0, F.lit("very_poor"))
        .otherwise(F.lit("no_overlap")))


def iou_band(iou: Column) -> Column:
    return (F.when(iou < 0.5, F.lit("failed")).when(iou < 0.75, F.lit("low_iou"))
            .when(iou < 0.9, F.lit("medium_iou")).when(iou < 0.95, F.lit("high_iou"))
            .when(iou.isNotNull(), F.lit("excellent")))


def run_score(iou: Column, err_mean: Column) -> Column:
    return iou * F.lit(100.0) - err_mean


def iou_transition(old: Column, new: Column) -> Column:
    """How a label's IoU moved between two rounds."""
    return (F.when((old >= 0.99) & (new >= 0.99), F.lit("confirmed"))
            .when((old < 0.99) & (new >= 0.99), F.lit("improved"))
            .when((old < 0.99) & (new >= 0.98), F.lit("probable"))
            .when((old < 0.99) & (new < 0.95), F.lit("outlier"))
            .when((old >= 0.99) & (new < 0.95), F.lit("regression"))
            .otherwise(F.lit("other")))
