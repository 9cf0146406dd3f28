"""CMP-*: comparison of two quads."""

from pyspark.sql import functions as F

from quadlab.catalog import query
from quadlab.catalog.shared import (
    box, corner_err, crossing, evaluated_ctes, iou_ctes, labelled_pairs, num, pairs_cte, q6, r6, sel, self_crossing, side, spread)
from quadlab import fixtures as X
from quadlab.functions import compare as C, geometry as G
from quadlab.functions.overlap import bbox_iou, with_polygon_iou
from quadlab.plans import cleaning as K


def gt():
    return F.col("gt")


def pred():
    return F.col("pred")


PR = pairs_cte()


@query("cmp_01_polygon_iou_raw", sel(f"SELECT pid AS sample_id, {q6('iou', 'iou')} FROM i", [PR, *iou_ctes("i", "pr")]))
def polygon_iou_raw(spark, sf):
    return with_polygon_iou(labelled_pairs(spark, sf), [("pred", "gt", "iou")]).select("sample_id", r6("iou"))


@query("cmp_02_polygon_iou_ccw", sel(
    f"SELECT pid AS sample_id, {q6('iou', 'iou')} FROM i WHERE aa > 0 AND ba > 0", [PR, *iou_ctes("i", "pr", "ccw")]))
def polygon_iou_ccw(spark, sf):
    rows = with_polygon_iou(labelled_pairs(spark, sf), [("pred", "gt", "iou")], order="ccw")
    return rows.where(F.col("iou").isNotNull()).select("sample_id", r6("iou"))


def bbox_sql(a: str, b: str, eps: str = "0e0") -> str:
    p, q = box(a), box(b)
    w = f"greatest(least({p['xmax']}, {q['xmax']}) - greatest({p['xmin']}, {q['xmin']}), 0e0)"
    h = f"greatest(least({p['ymax']}, {q['ymax']}) - greatest({p['ymin']}, {q['ymin']}), 0e0)"
    return f"(CASE WHEN {p['area']} + {q['area']} > 0 THEN ({w} * {h}) / ({p['area']} + {q['area']} - {w} * {h} + {eps}) ELSE 0e0 END)"


# whole: the two triangles of a self-crossing label are two separate overlaps whose areas add up
def _both_pieces_cte() -> list[tuple[str, str]]:
    def pieces(n: int) -> str:
        def x(a, b, c, d):
            t = f"({side('b', c, d, a)} / ({side('b', c, d, a)} - {side('b', c, d, b)}))"
            return f"(b{2*a} + {t} * (b{2*b} - b{2*a}))", f"(b{2*a+1} + {t} * (b{2*b+1} - b{2*a+1}))"
        one, two = crossing("b", 0, 1, 2, 3), crossing("b", 1, 2, 3, 0)
        x1, x2 = x(0, 1, 2, 3), x(1, 2, 3, 0)
        keep = {1: [(1, 2), (2, 3)], 2: [(3, 0), (0, 1)]}[n]
        out = []
        for slot in range(4):
            for axis in (0, 1):
                if slot == 0:
                    v1, v2 = x1[axis], x2[axis]
                else:
                    pick = 0 if slot == 1 else 1
                    v1, v2 = f"b{2*keep[0][pick] + axis}", f"b{2*keep[1][pick] + axis}"
                out.append(f"CASE WHEN {one} THEN {v1} WHEN {two} THEN {v2} END AS b{2*slot + axis}")
        return ", ".join(out)
    a = ", ".join(f"a{i}" for i in range(8))
    tangled = f"SELECT * FROM pr WHERE {self_crossing('b')}"
    split = " UNION ALL ".join(f"SELECT pid * 2 + {n - 1} AS pid, {a}, {pieces(n)} FROM ({tangled}) t" for n in (1, 2))
    return [("wp", split), *iou_ctes("wi", "wp")]


@query("cmp_03_iou_variants", sel(
    f"SELECT i.pid AS sample_id, {q6('coalesce(wi.iou, i.iou)', 'whole')}, "
    f"{q6('CASE WHEN x THEN bb ELSE i.iou END', 'fallback')}, {q6('CASE WHEN x THEN 0e0 ELSE i.iou END', 'strict')} "
    f"FROM i JOIN (SELECT pid, {self_crossing('b')} AS x, {bbox_sql('a', 'b', '1e-9')} AS bb FROM pr) p ON i.pid = p.pid LEFT JOIN "
    f"(SELECT pid // 2 AS pid, sum(inter) / (any_value(aa) + sum(ba) - sum(inter)) AS iou FROM wi GROUP BY 1) wi ON i.pid = wi.pid",
    [PR, *iou_ctes("i", "pr"), *_both_pieces_cte()]))
def iou_variants(spark, sf):
    rows = labelled_pairs(spark, sf)
    for mode in ("whole", "bbox_fallback", "strict"):
        rows = with_polygon_iou(rows, [("pred", "gt", mode)], mode=mode)
    return rows.select("sample_id", r6("whole"), r6("bbox_fallback", "fallback"), r6("strict"))


@query("cmp_04_bbox_iou", sel(f"SELECT pid AS sample_id, {q6(bbox_sql('a', 'b'), 'iou')}, {q6(bbox_sql('a', 'b', '1e-9'), 'iou_eps')} FROM pr", [PR]))
def bbox_iou_q(spark, sf):
    return labelled_pairs(spark, sf).select("sample_id", r6(bbox_iou(pred(), gt()), "iou"), r6(bbox_iou(pred(), gt(), 1e-9), "iou_eps"))


ERR = corner_err("a", "b")


@query("cmp_05_corner_error", sel(
    f"SELECT pid AS sample_id, {', '.join(q6(e, f'e{i}') for i, e in enumerate(ERR))}, {q6('(' + ' + '.join(ERR) + ') / 4e0', 'err_mean')}, "
    f"{q6('greatest(' + ', '.join(ERR) + ')', 'err_max')} FROM pr", [PR]))
def corner_error(spark, sf):
    return labelled_pairs(spark, sf).select(
        "sample_id", *[r6(e, f"e{i}") for i, e in enumerate(C.corner_errors(pred(), gt(), 224.0))],
        r6(C.corner_error_mean(pred(), gt()), "err_mean"), r6(C.corner_error_max(pred(), gt()), "err_max"))


@query("cmp_06_coord_error_l1", sel(
    f"SELECT pid AS sample_id, {q6('(' + ' + '.join(f'abs(a{i} - b{i})' for i in range(8)) + ') * 28e0', 'l1')} FROM pr", [PR]))
def coord_error_l1(spark, sf):
    return labelled_pairs(spark, sf).select("sample_id", r6(C.coord_error_l1(pred(), gt()), "l1"))


def _roll_sql(moving: str, fixed: str, sign: int) -> str:
    out = []
    for r in range(4):
        e = [f"sqrt(power(({moving}{2*((i + sign*r)%4)} - {fixed}{2*i}) * w, 2) + power(({moving}{2*((i + sign*r)%4)+1} - {fixed}{2*i+1}) * h, 2))"
             for i in range(4)]
        out.append(f"{{'t': {' + '.join(e)}, 'r': {r}, 'm': greatest({', '.join(e)})}}")
    return f"list_sort([{', '.join(out)}])[1]"


SIZED = "(SELECT p.*, w, h FROM pr p JOIN image_sizes z ON p.pid = z.sample_id)"


def _sized(spark, sf):
    return (labelled_pairs(spark, sf).join(X.sizes(spark, sf).select("name", "w", "h"), "name")
            .withColumns({"w": F.col("w").cast("double"), "h": F.col("h").cast("double")}))


@query("cmp_07_corner_error_best_rotation", sel(
    f"SELECT pid AS sample_id, {q6('b.t / 4e0', 'err_mean')}, {q6('b.m', 'err_max')} FROM "
    f"(SELECT pid, {_roll_sql('a', 'b', -1)} AS b FROM {SIZED} s) z", [PR]))
def corner_error_best_rotation(spark, sf):
    rows = _sized(spark, sf).withColumn("b", C.corner_error_best_rotation(pred(), gt(), F.col("w"), F.col("h")))
    return rows.select("sample_id", r6("b.mean", "err_mean"), r6("b.max", "err_max"))


@query("cmp_08_best_rotation", sel(
    f"SELECT pid AS sample_id, CAST(b.r AS INT) AS rot, {q6('b.t / 4e0', 'err_mean')} FROM "
    f"(SELECT pid, {_roll_sql('b', 'a', 1)} AS b FROM {SIZED} s) z", [PR]))
def best_rotation(spark, sf):
    rows = _sized(spark, sf).withColumn("b", C.best_rotation(gt(), pred(), F.col("w"), F.col("h")))
    return rows.select("sample_id", "b.rot", r6("b.mean", "err_mean"))


DIAG = [f"({e}) / sqrt(w * w + h * h)" for e in corner_err("a", "b", "w", "h")]


@query("cmp_09_corner_distance_diag", sel(
    f"SELECT pid AS sample_id, {', '.join(q6(e, f'd{i}') for i, e in enumerate(DIAG))}, {q6('greatest(' + ', '.join(DIAG) + ')', 'd_max')}, "
    f"{q6('(' + ' + '.join(DIAG) + ') / 4e0', 'd_avg')} FROM {SIZED} s", [PR]))
def corner_distance_diag(spark, sf):
    d = C.corner_distance_diag(gt(), pred(), F.col("w"), F.col("h"))
    return _sized(spark, sf).select("sample_id", *spread(d["corners"], "d", 6, 4), r6(d["max"], "d_max"), r6(d["avg"], "d_avg"))


def category_sql() -> str:
    far = f"greatest({', '.join(corner_err('c', 'g', '1e0'))}) / sqrt(2e0)"
    return (f"CASE WHEN NOT has_doc AND detected = 0 THEN 'true_negative' WHEN NOT has_doc THEN 'false_positive' "
            f"WHEN detected = 0 THEN 'false_negative' WHEN iou >= 0.9 THEN 'excellent' WHEN iou >= 0.7 THEN 'good' "
            f"WHEN iou >= 0.5 THEN CASE WHEN {far} > 0.15 THEN 'corner_outlier' ELSE 'moderate' END "
            f"WHEN iou >= 0.3 THEN 'poor' WHEN iou > 0 THEN 'very_poor' ELSE 'no_overlap' END")


def categorized(spark, sf):
    """Every sample with its error category; distances are in a unit image."""
    rows = K.evaluated(X.samples(spark, sf), X.labels(spark, sf).select("stem", "coords"), X.predictions(spark, sf), "teacher")
    d = C.corner_distance_diag(gt(), pred(), F.lit(1.0), F.lit(1.0))["max"]
    return rows.withColumn("category", C.error_category(F.col("iou"), d, F.col("has_doc"), F.col("detected") == 1))


@query("cmp_10_error_category", sel(f"SELECT sample_id, {category_sql()} AS category FROM ev", evaluated_ctes()))
def error_category(spark, sf):
    return categorized(spark, sf).select("sample_id", "category")


@query("cmp_11_iou_band", sel(
    f"SELECT sample_id, CASE WHEN iou < 0.5 THEN 'failed' WHEN iou < 0.75 THEN 'low_iou' WHEN iou < 0.9 THEN 'medium_iou' "
    f"WHEN iou < 0.95 THEN 'high_iou' ELSE 'excellent' END AS band, CAST(err_mean > 10 AS INT) AS high_error FROM ev WHERE has_doc",
    evaluated_ctes()))
def iou_band(spark, sf):
    rows = categorized(spark, sf).where("has_doc")
    return rows.select("sample_id", C.iou_band(F.col("iou")).alias("band"), num(F.col("err_mean") > 10).alias("high_error"))


@query("cmp_12_run_score", sel(f"SELECT sample_id, {q6('iou * 100 - err_mean', 'score')} FROM ev WHERE has_doc", evaluated_ctes()))
def run_score(spark, sf):
    rows = categorized(spark, sf).where("has_doc")
    return rows.select("sample_id", r6(C.run_score(F.col("iou"), F.col("err_mean")), "score"))


@query("cmp_13_iou_transition", sel(
    "SELECT CASE WHEN a.iou >= 0.99 THEN CASE WHEN b.iou >= 0.99 THEN 'confirmed' WHEN b.iou < 0.95 THEN 'regression' ELSE 'other' END "
    "WHEN b.iou >= 0.99 THEN 'improved' WHEN b.iou >= 0.98 THEN 'probable' WHEN b.iou < 0.95 THEN 'outlier' ELSE 'other' END AS transition, "
    "count(*) AS n FROM i a JOIN j b ON a.pid = b.pid GROUP BY 1",
    [PR, pairs_cte("winner", "pw"), *iou_ctes("i", "pr"), *iou_ctes("j", "pw")]))
def iou_transition(spark, sf):
    old = with_polygon_iou(labelled_pairs(spark, sf, "teacher"), [("pred", "gt", "old")]).select("sample_id", "old")
    new = with_polygon_iou(labelled_pairs(spark, sf, "winner"), [("pred", "gt", "new")]).select("sample_id", "new")
    return (old.join(new, "sample_id").groupBy(C.iou_transition(F.col("old"), F.col("new")).alias("transition"))
            .agg(F.count("*").alias("n")))
