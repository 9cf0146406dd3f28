"""JOB-*: whole jobs, and the counters that belong to them (AG-11, AG-19)."""

import numpy as np
from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.aggregates import EV, NEG, ev, reviewed, reviewed_ctes, rounded
from quadlab.catalog.arrays import quality
from quadlab.catalog.compare import bbox_sql
from quadlab.catalog.geometry import (
    A as ANGLES, B, CORNER_TESTS, LAB, QUAD_TESTS, TOUCH_TESTS, angle_sql, convex_sql, issue_rows, sane_sql)
from quadlab.catalog.joins import OLD_NEW, base, events, index, runs
from quadlab.catalog.ranking import hard_sql
from quadlab.catalog.sets import HASH, SEED
from quadlab.catalog.shared import (
    audit_ctes, box, ccw_sql, cols, iou_ctes, labelled_pairs, num, pairs_cte, q6, r6, sel, self_crossing, shoelace, spread)
from quadlab.checkpoints import cut
from quadlab.functions import geometry as G
from quadlab.operators import joins as J, metrics as M, scoring, sampling as S
from quadlab.operators.ranking import global_running, places
from quadlab.plans import audit as A, cleaning as K, consensus as V, relabel as L, review as W

# ---------------------------------------------------------------- consensus

PAIRS = [("g", "t"), ("g", "w"), ("g", "d"), ("t", "w"), ("t", "d"), ("w", "d")]
SRC = {"t": "teacher", "w": "winner", "d": "docaligner"}


def consensus_ctes() -> list[tuple[str, str]]:
    """cv: one row per sample with the six IoUs, the agreeing pick and the action."""
    clip = ", ".join(f"least(greatest(g{i}, 0e0), 1e0) AS g{i}" for i in range(8))
    quads = [("qs", f"SELECT sample_id, 'g' AS q, {clip} FROM quad_samples WHERE g0 IS NOT NULL UNION ALL SELECT p.sample_id, "
                    f"substr(p.source, 1, 1) AS q, {', '.join(f'p.c{i} AS g{i}' for i in range(8))} FROM quad_predictions p JOIN quad_samples s "
                    f"ON p.sample_id = s.sample_id WHERE p.detected = 1 AND s.g0 IS NOT NULL"),
             ("cp", "SELECT a.sample_id * 8 + CASE a.q || b.q " + " ".join(f"WHEN '{x}{y}' THEN {n}" for n, (x, y) in enumerate(PAIRS))
              + " END AS pid, " + ", ".join(f"a.g{i} AS a{i}, b.g{i} AS b{i}" for i in range(8)) + " FROM qs a JOIN qs b ON a.sample_id = b.sample_id "
              "AND (a.q || b.q) IN (" + ", ".join(f"'{x}{y}'" for x, y in PAIRS) + ")"),
             *iou_ctes("ci", "cp", "ccw"),
             ("ok", "SELECT sample_id, " + ", ".join(f"coalesce(bool_or(q = '{q}' AND area > 0), false) AS h_{q}" for q in "gtwd")
              + f" FROM (SELECT sample_id, q, {shoelace('o')} AS area FROM ({ccw_sql('qs', 'g', 'o', 'sample_id, q')}) o) z GROUP BY sample_id"),
             ("cw", "SELECT pid // 8 AS sample_id, " + ", ".join(
                 f"max(CASE WHEN pid % 8 = {n} AND aa > 0 AND ba > 0 THEN iou END) AS i_{x}{y}" for n, (x, y) in enumerate(PAIRS)) + " FROM ci GROUP BY 1")]
    pick = ("CASE WHEN coalesce(i_tw >= 0.95, false) OR coalesce(i_td >= 0.95, false) THEN 'teacher' WHEN i_wd >= 0.95 THEN 'winner' END")
    rows = (f"SELECT s.*, starts_with(s.name, 'negative_') AS neg, starts_with(s.name, 'MIDV') OR s.name ILIKE 'smartdoc%' AS prot, {pick} AS pick, "
            f"{', '.join(f'coalesce(h_{q}, false) AS h_{q}' for q in 'gtwd')}, {', '.join(f'i_{x}{y}' for x, y in PAIRS)}, "
            f"greatest(0e0, {', '.join(f'coalesce(i_{x}{y}, 0e0)' for x, y in PAIRS)}) AS top "
            f"FROM quad_samples s LEFT JOIN cw ON s.sample_id = cw.sample_id LEFT JOIN ok ON s.sample_id = ok.sample_id")
    n = " + ".join(f"CAST(h_{q} AS INT)" for q in "gtwd")
    action = (f"CASE WHEN neg THEN 'keep_negative' WHEN g0 IS NULL THEN 'keep_missing_gt' WHEN i_gt >= 0.995 THEN 'replace_teacher_high_iou' "
              f"WHEN pick IS NOT NULL THEN CASE WHEN (CASE WHEN pick = 'teacher' THEN i_gt ELSE i_gw END) <= 0.85 THEN 'replace_' || pick || '_cluster' "
              f"ELSE 'keep_gt_cluster_not_far' END WHEN {n} >= 3 AND top < 0.5 THEN CASE WHEN prot THEN 'keep_gt_protected' ELSE 'drop' END ELSE 'keep_gt' END")
    return quads + [("cv", f"SELECT *, {n} AS n_polys, {action} AS action FROM ({rows}) r")]


CV = consensus_ctes()


def decisions(spark, sf):
    s, lab, p = base(spark, sf)
    return V.consensus_vote(s, lab, p)


@query("job_01_consensus_vote", sel(
    "SELECT split, name, CAST(prot AS INT) AS protected, action, CASE WHEN action IN ('keep_negative', 'drop') THEN 'none' WHEN action = 'keep_missing_gt' THEN 'gt_missing' "
    "WHEN action = 'replace_teacher_high_iou' THEN 'teacher' WHEN starts_with(action, 'replace') THEN pick ELSE 'gt' END AS chosen_source, "
    + ", ".join(q6(f"i_{x}{y}", f"iou_{x}{y}") for x, y in PAIRS) + ", " + q6("CASE WHEN n_polys >= 2 THEN top END", "max_pairwise_iou") + " FROM cv", CV))
def consensus_vote(spark, sf):
    full = {"g": "gt", **SRC}
    return decisions(spark, sf).select(
        "split", "name", num(F.col("protected")).alias("protected"), "action", "chosen_source",
        *[r6(f"iou_{full[x]}_{full[y]}", f"iou_{x}{y}") for x, y in PAIRS], r6("max_pairwise_iou"))


@query("job_01_consensus_labels", sel(
    f"SELECT name, {', '.join(q6(f'least(greatest(o{i}, 0e0), 1e0)', f'n{i}') for i in range(8))} FROM fin", [*CV,
        ("cho", "SELECT c.sample_id, c.name, " + ", ".join(f"p.c{i}" for i in range(8)) + " FROM cv c JOIN quad_predictions p ON c.sample_id = p.sample_id AND p.source = "
         "CASE WHEN c.action = 'replace_teacher_high_iou' THEN 'teacher' ELSE c.pick END WHERE starts_with(c.action, 'replace')"),
        ("cco", ccw_sql("cho", "c", "d", "name")),
        ("fin", "SELECT name, " + ", ".join(
            f"CASE WHEN r[2].y > r[4].y THEN r[{[1, 4, 3, 2][i]}].{c} ELSE r[{i + 1}].{c} END AS o{2*i + n}" for i in range(4) for n, c in enumerate("xy"))
         + " FROM (SELECT name, [" + ", ".join(f"{{'x': d{2*i}, 'y': d{2*i+1}}}" for i in (0, 1, 2, 3, 0, 1, 2, 3)) + "]["
         + (st := "list_position([" + ", ".join(f"d{2*i} + d{2*i+1}" for i in range(4)) + "], least(" + ", ".join(f"d{2*i} + d{2*i+1}" for i in range(4)) + "))")
         + f":{st} + 3] AS r FROM cco) z")]))
def consensus_labels(spark, sf):
    """The replaced labels."""
    return decisions(spark, sf).where(F.col("new_coords").isNotNull()).select("name", *spread(F.col("new_coords"), "n", 6))


@query("ag_11_decision_counts", sel(
    "SELECT count(*) AS total, count(*) FILTER (WHERE NOT neg) AS positives, count(*) FILTER (WHERE neg) AS negatives, count(*) FILTER (WHERE action <> 'drop') AS kept, "
    "count(*) FILTER (WHERE action = 'drop') AS dropped, count(*) FILTER (WHERE starts_with(action, 'replace')) AS changed_labels, "
    "count(*) FILTER (WHERE action <> 'drop' AND prot AND NOT neg AND g0 IS NOT NULL) AS kept_protected, "
    "count(*) FILTER (WHERE action = 'keep_gt_protected') AS dropped_attempted_protected FROM cv", CV))
def decision_counts(spark, sf):
    return V.decision_counts(decisions(spark, sf))


@query("ag_11_guarded_counts", sel(
    "SELECT count(*) AS total, count(*) FILTER (WHERE NOT neg) AS positives, count(*) FILTER (WHERE neg) AS negatives, count(*) AS kept, 0 AS dropped, "
    "count(*) FILTER (WHERE starts_with(action, 'replace')) AS changed_labels, count(*) FILTER (WHERE prot AND NOT neg AND g0 IS NOT NULL) AS kept_protected, "
    "count(*) FILTER (WHERE action = 'keep_gt_protected') AS dropped_attempted_protected FROM cv", CV))
def guarded_counts(spark, sf):
    """A minimum above the sample count restores every row, and the counters say so."""
    # the guard reads the rows twice; of the quads only their presence counts
    present = [F.when(F.col(c).isNotNull(), F.lit(1)).alias(c) for c in ("gt", "new_coords")]
    d = cut(decisions(spark, sf).select("is_negative", "action", "kept", "protected", *present))
    return V.decision_counts(V.min_total_guard(d, 1 << 40))


@query("job_02_min_total_guard", sel(
    "SELECT 'low' AS guard, split, count(*) FILTER (WHERE action <> 'drop') AS n_in FROM cv GROUP BY split UNION ALL "
    "SELECT 'high' AS guard, split, count(*) AS n_in FROM cv GROUP BY split", CV))
def min_total_guard(spark, sf):
    """A minimum of one row lets drops stand; one above the sample count undoes them."""
    d = cut(decisions(spark, sf).select("split", "name", "kept"))
    out = [V.min_total_guard(d, m).groupBy(F.lit(tag).alias("guard"), "split").agg(F.count_if("in_split").alias("n_in"))
           for tag, m in (("low", 1), ("high", 1 << 40))]
    return out[0].unionByName(out[1])


@query("job_24_uncertain_kept", sel(
    f"SELECT name, action, {q6('top', 'max_pairwise_iou')} FROM cv WHERE action <> 'drop' AND n_polys >= 2 AND top < 0.5 AND "
    f"CAST(h_t AS INT) + CAST(h_w AS INT) + CAST(h_d AS INT) = 1", CV))
def uncertain_kept(spark, sf):
    return V.uncertain_kept(decisions(spark, sf)).select("name", "action", r6("max_pairwise_iou"))


# ---------------------------------------------------------------- audits

GVT = [("gp", pairs_cte()[1].replace("SELECT s.sample_id AS pid", "SELECT s.sample_id AS pid", 1)),
       ("gc", "SELECT pid, split, name, conf, " + cols("a") + ", " + ", ".join(f"least(greatest(b{i}, 0e0), 1e0) AS b{i}" for i in range(8)) + " FROM gp"),
       *iou_ctes("gi", "gc", "ccw"),
       ("gv", "SELECT s.sample_id, s.split, s.name, s.g0 IS NOT NULL AS ok, p.sample_id IS NOT NULL AS has_row, coalesce(p.detected, 0) AS det, "
              "coalesce(p.conf, 0e0) AS conf, CASE WHEN i.aa > 0 AND i.ba > 0 THEN i.iou END AS raw FROM quad_samples s LEFT JOIN quad_predictions p "
              f"ON s.sample_id = p.sample_id AND p.source = 'teacher' LEFT JOIN gi i ON s.sample_id = i.pid WHERE NOT starts_with(s.name, 'negative_')")]


def gvt(spark, sf):
    s, lab, p = base(spark, sf)
    return A.gt_vs_teacher(s, lab, p, min_conf=0.9)


@query("job_03_gt_vs_teacher", sel(
    f"SELECT split, name, CAST(ok AS INT) AS gt_valid, CASE WHEN ok THEN det END AS teacher_detected, {q6('CASE WHEN ok THEN conf END', 'teacher_conf')}, "
    f"{q6('CASE WHEN ok THEN coalesce(raw, 0) END', 'iou')}, {q6('CASE WHEN ok AND conf >= 0.9 THEN raw END', 'iou_at_min_conf')} FROM gv", GVT))
def gt_vs_teacher(spark, sf):
    return rounded(gvt(spark, sf).drop("has_row"))


@query("job_03_gt_teacher_diff", sel("SELECT split, name FROM gv WHERE ok AND (NOT has_row OR det <> 1 OR coalesce(raw, 0) < 0.9)", GVT))
def gt_teacher_diff(spark, sf):
    return A.gt_teacher_diff(gvt(spark, sf)).select("split", "name")


AU = audit_ctes()


def audit(spark, sf):
    s, lab, p = base(spark, sf)
    return A.teacher_audit(s, lab, p, X.sizes(spark, sf))


@query("job_04_teacher_audit", sel(
    f"SELECT split, name, CAST(image_exists AS INT) AS image_exists, CAST(label_exists AS INT) AS label_exists, detected AS teacher_detected, "
    f"{q6('conf', 'teacher_conf')}, CAST(gt_valid AS INT) AS gt_valid, CAST(gt_oob AS INT) AS gt_oob, {q6('gt_area_ratio', 'gt_area_ratio')}, {q6('iou', 'iou')}, "
    f"{q6('rot.t / 4e0', 'err_mean_px')}, coalesce(rot.r, -1) AS rot FROM au", AU))
def teacher_audit(spark, sf):
    return rounded(audit(spark, sf).select(
        "split", "name", "image_exists", "label_exists", "teacher_detected", "teacher_conf", "gt_valid", "gt_oob", "gt_area_ratio", "iou",
        "err_mean_px", F.coalesce("gt_rot_to_teacher", F.lit(-1)).alias("rot")))


@query("job_05_teacher_removals", sel(
    "SELECT split, name, reason FROM (SELECT *, CASE WHEN NOT image_exists THEN NULL WHEN is_negative THEN CASE WHEN detected = 1 AND conf >= 0.95 THEN "
    "'detected_on_negative' END WHEN NOT gt_valid THEN 'gt_invalid' WHEN gt_oob THEN 'gt_out_of_bounds' WHEN detected = 1 AND ((conf >= 0.99 AND iou <= 0.5) "
    "OR (conf >= 0.95 AND iou <= 0.3)) THEN 'teacher_mismatch' END AS reason FROM au) z WHERE reason IS NOT NULL", AU))
def teacher_removals(spark, sf):
    return A.teacher_removals(audit(spark, sf)).select("split", "name", "reason")


@query("job_06_label_order_fix", sel(
    "SELECT name, rot.r AS rot, " + ", ".join(f"[{', '.join(f'g{j}' for j in range(8))}][(2 * rot.r + {i}) % 8 + 1] AS f{i}" for i in range(8))
    + " FROM au WHERE NOT is_negative AND gt_valid AND NOT gt_oob AND detected = 1 AND iou >= 0.98 AND rot.r <> 0 AND rot.t / 4e0 <= 10", AU))
def label_order_fix(spark, sf):
    return A.label_order_fix(audit(spark, sf)).select("name", F.col("gt_rot_to_teacher").alias("rot"), *spread(F.col("fixed"), "f"))


def _outlier_ctes() -> list[tuple[str, str]]:
    g, o = box("g"), box("o")
    e = [f"sqrt(power(o{2*((i+1)%4)} - o{2*i}, 2) + power(o{2*((i+1)%4)+1} - o{2*i+1}, 2))" for i in range(4)]
    a = angle_sql("o")
    margin = f"least({g['xmin']}, {g['ymin']}, 1 - {g['xmax']}, 1 - {g['ymax']})"
    px = f"least({g['xmin']} * w, {g['ymin']} * h, (1 - {g['xmax']}) * w, (1 - {g['ymax']}) * h)"
    # the audit row carries the size only when the image exists
    return [*AU, ("oo", ccw_sql("(SELECT * FROM quad_samples WHERE g0 IS NOT NULL)", "g", "o", f"sample_id, split, name, {cols('g')}")),
            ("of1", f"SELECT o.sample_id, o.split, o.name, {margin} AS margin, {shoelace('o')} AS area, {self_crossing('g')} AS x, {convex_sql('o')} AS convex, "
                    f"{px} AS margin_px, coalesce({margin} <= 0.005 OR {px} <= 3, false) AS border, {shoelace('o')} <= 0.05 OR least({g['w']}, {g['h']}) <= 0.15 AS small, "
                    f"{self_crossing('g')} OR NOT {convex_sql('o')} OR (CASE WHEN {g['area']} > 1e-9 THEN {shoelace('o')} / {g['area']} ELSE 0 END) <= 0.55 OR "
                    f"least({', '.join(e)}) <= 1e-9 OR greatest({', '.join(e)}) / least({', '.join(e)}) >= 10 OR least({', '.join(a)}) <= 20 OR greatest({', '.join(a)}) >= 160 AS weird, "
                    f"a.detected, a.conf, a.iou FROM oo o LEFT JOIN (SELECT sample_id, w, h, detected, conf, iou FROM au) a ON o.sample_id = a.sample_id"),
            ("of", "SELECT *, concat_ws(',', CASE WHEN border THEN 'border' END, CASE WHEN small THEN 'small' END, CASE WHEN weird THEN 'weird' END) AS flags, "
                   "coalesce(detected = 1 AND conf >= 0.9 AND iou >= 0.9, false) AS confirmed FROM of1 WHERE border OR small OR weird")]


OF = _outlier_ctes()


def outliers(spark, sf):
    s, lab, _ = base(spark, sf)
    return A.gt_outliers(s, lab, A.audit_table(audit(spark, sf)))


@query("job_07_gt_outliers", sel(
    f"SELECT split, name, flags, {q6('margin', 'border_margin_norm')}, {q6('margin_px', 'border_margin_px')}, {q6('area', 'area_ratio')}, "
    f"CAST(confirmed AS INT) AS confirmed FROM of", OF))
def gt_outliers(spark, sf):
    return rounded(outliers(spark, sf).select("split", "name", "flags", "border_margin_norm", "border_margin_px", "area_ratio",
                                              num(F.col("teacher_confirmed")).alias("confirmed")))


@query("ag_11_outlier_counts", sel(
    "SELECT count(*) AS \"any\", count(*) FILTER (WHERE border) AS near_border, count(*) FILTER (WHERE small) AS small, count(*) FILTER (WHERE weird) AS weird, "
    "count(*) FILTER (WHERE confirmed) AS confirmed FROM of", OF))
def outlier_counts(spark, sf):
    return A.outlier_counts(outliers(spark, sf))


IMG = ("im", "SELECT sample_id, min_by(ext, priority) AS ext FROM quad_images GROUP BY sample_id")
SMALL = [("area", shoelace("g"), 0.05), ("width", B["w"], 0.1), ("height", B["h"], 0.1)]


def small_sql(where: str) -> str:
    reason = ", ".join(f"CASE WHEN {e} < {t} THEN printf('{n}=%.4f < {t}', {e}) END" for n, e, t in SMALL)
    return (f"SELECT name[:-5] || ext AS name, {', '.join(f'{e} AS {n}' for n, e, _ in SMALL)}, concat_ws(', ', {reason}) AS reason, "
            f"split_part(name, '_', 1) || '_' || split_part(name, '_', 2) AS prefix FROM quad_samples s JOIN im ON s.sample_id = im.sample_id "
            f"WHERE g0 IS NOT NULL AND ({' OR '.join(f'{e} < {t}' for _, e, t in SMALL)}) AND {where}")


@query("job_08_small_boxes", sel(small_sql("true"), [IMG]))
def small_boxes(spark, sf):
    return A.small_boxes(base(spark, sf)[1], X.images(spark, sf).select("stem", "ext"))


@query("job_08_small_boxes_by_prefix", sel(small_sql("starts_with(name, 'id') AND NOT starts_with(name, 'idcard_final')"), [IMG]))
def small_boxes_by_prefix(spark, sf):
    return A.small_boxes(base(spark, sf)[1], X.images(spark, sf).select("stem", "ext"), prefixes=["id"], exclude=["idcard_final"])


IMAGED = "(SELECT s.*, name[:-5] || ext AS img FROM quad_samples s JOIN im ON s.sample_id = im.sample_id WHERE g0 IS NOT NULL AND {w})"


@query("job_09_quad_issue_report", sel(
    "SELECT img AS name, issue, split_part(issue, ':', 1) AS issue_type FROM (" + issue_rows(
        QUAD_TESTS, IMAGED.format(w="(starts_with(name, 'id_detections') OR starts_with(name, 'id_card'))"), "img") + ") i", [IMG]))
def quad_issue_report(spark, sf):
    return A.quad_issue_report(base(spark, sf)[1], X.images(spark, sf).select("stem", "ext"), ["id_detections", "id_card"])


def _deep_sql() -> tuple[str, list]:
    from quadlab.catalog import ORACLES
    looks = ORACLES["arr_08_image_quality_issues"]
    own = issue_rows(CORNER_TESTS + TOUCH_TESTS, "ld", "img")
    return ("SELECT img AS name, split_part(issue, ':', 1) AS issue_type, issue FROM (" + own + " UNION ALL SELECT l.img, q.issue FROM ld l JOIN lq q "
            "ON l.sample_id = q.vec_id UNION ALL SELECT img, 'duplicate_image:' || h || ' x' || n FROM (SELECT l.img, d.h, count(*) OVER (PARTITION BY d.h) AS n "
            "FROM ld l JOIN doc_hashes d ON l.sample_id = d.sample_id) z WHERE n > 1) y",
            [IMG, ("lq", looks), ("ld", "SELECT s.*, name[:-5] || ext AS img FROM quad_samples s JOIN im ON s.sample_id = im.sample_id WHERE g0 IS NOT NULL")])


@query("job_09_deep_issue_report", sel(*_deep_sql()))
def deep_issue_report(spark, sf):
    """Quality from the embedding with the sample's number, duplicates from the document with it."""
    lab = X.labels(spark, sf)
    q = quality(spark, sf).join(lab.select("stem", F.col("sample_id").alias("vec_id")), "vec_id").select("stem", "issues")
    h = X.doc_hashes(spark, sf).join(lab.select("stem", "sample_id"), "sample_id").select("stem", F.col("h").alias("hash"))
    return A.deep_issue_report(lab.select("stem", "coords"), X.images(spark, sf).select("stem", "ext"), q, h).select("name", "issue_type", "issue")


# ---------------------------------------------------------------- evaluation, mining and cleaning

EVALS = f"{q6('iou', 'iou')}, {q6('err_mean', 'err_mean')}, {q6('err_max', 'err_max')}"


@query("job_10_full_evaluation", sel(f"SELECT split, name, {EVALS}, {q6('iou * 100 - err_mean', 'score')} FROM ev WHERE has_doc", EV))
def full_evaluation(spark, sf):
    return rounded(K.full_evaluation(*base(spark, sf), "teacher"))


@query("job_10_evaluation_order", sel("SELECT name, row_number() OVER (ORDER BY round(iou, 6) DESC, name) AS place FROM ev WHERE has_doc", EV))
def evaluation_order(spark, sf):
    """Place of each row in the evaluation file."""
    rows = K.in_evaluation_order(rounded(K.full_evaluation(*base(spark, sf), "teacher")))
    return global_running(rows.select("name", F.monotonically_increasing_id().alias("at")), ["at"], out="place").select("name", "place")


@query("job_11_worst_rows", sel(
    f"SELECT split, name, {EVALS}, {q6(bbox_sql('c', 'g'), 'iou_bbox')}, {q6('score', 'score')} FROM ev WHERE has_doc ORDER BY round(err_mean, 6) DESC, name LIMIT 200", EV))
def worst_rows(spark, sf):
    return rounded(K.worst_rows(ev(spark, sf).withColumn("err_mean", F.round("err_mean", 6)), 200))


@query("job_11_worst_cases", sel(f"SELECT name, {EVALS} FROM ev WHERE has_doc AND err_mean >= 5 ORDER BY round(err_mean, 6) DESC, name LIMIT 200", EV))
def worst_cases(spark, sf):
    return K.worst_cases(rounded(K.full_evaluation(*base(spark, sf), "teacher")), 5.0, 200).select("name", "iou", "err_mean", "err_max")


@query("job_12_find_outliers", sel(f"SELECT split, name, {EVALS}, {q6('iou * 100 - err_mean', 'score')}, "
                                    "row_number() OVER (ORDER BY round(err_mean, 6) DESC, name) AS place FROM ev WHERE has_doc AND round(err_mean, 6) >= 10", EV))
def find_outliers(spark, sf):
    """All columns, and the place of each row in the order of the result."""
    rows = K.find_outliers(rounded(K.full_evaluation(*base(spark, sf), "teacher")), 10.0)
    # the order is part of the result: rows carry the number of their task and their place in it
    return places(rows.withColumns({"all": F.lit(0), "at": F.monotonically_increasing_id()}), "all", ["at"]).drop("all", "at")


@query("job_13_mine_hard_examples", sel(hard_sql("SELECT * FROM ev WHERE has_doc AND (iou < 0.9 OR err_mean > 15)"), EV))
def mine_hard_examples(spark, sf):
    return K.mine_hard_examples(ev(spark, sf), 0.9, 15.0).select("name", "prio", r6("key"))


@query("job_13_mine_top_k", sel(hard_sql("SELECT * FROM (SELECT * FROM ev WHERE has_doc ORDER BY iou, name LIMIT 300) k"), EV))
def mine_top_k(spark, sf):
    return K.mine_hard_examples(ev(spark, sf), top_k=300).select("name", "prio", r6("key"))


def _target_sql(share: str = "0.1") -> tuple[str, list]:
    ctes = [*EV, ("cs", f"SELECT *, CASE WHEN has_doc THEN CASE WHEN sample_id % 17 = 0 THEN 'outliers.txt' WHEN NOT coalesce({sane_sql('g')}, false) "
                        f"THEN 'label_invalid' END END AS r0 FROM ev"),
            ("cvl", "SELECT name, CASE WHEN suffix / cnt < 0.97 AND (rn - 1) / n <= 0.3 THEN 'low_iou_to_hit_target' END AS r FROM (SELECT name, "
                    "row_number() OVER (ORDER BY iou, name) AS rn, count(*) OVER () * 1e0 AS n, sum(iou) OVER (ORDER BY iou DESC, name DESC) AS suffix, "
                    "row_number() OVER (ORDER BY iou DESC, name DESC) AS cnt FROM cs WHERE has_doc AND r0 IS NULL AND split = 'val') z"),
            ("ctr", f"SELECT name, CASE WHEN rn <= floor({share} * n) THEN 'large_error' END AS r FROM (SELECT name, row_number() OVER (ORDER BY err_mean DESC, name) AS rn, "
                    "count(*) OVER () AS n FROM cs WHERE has_doc AND r0 IS NULL AND split <> 'val') z")]
    return ("SELECT c.split, c.name, coalesce(c.r0, v.r, t.r, 'kept') AS reason FROM cs c LEFT JOIN cvl v ON c.name = v.name LEFT JOIN ctr t ON c.name = t.name", ctes)


@query("job_14_clean_splits_by_target", sel(*_target_sql()))
def clean_splits_by_target(spark, sf):
    rows = K.clean_splits_by_target(ev(spark, sf), X.outlier_names(spark, sf), 0.97, 0.3, 0.1)
    return rows.select("split", "name", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("job_14_clean_splits_same_share", sel(*_target_sql("(SELECT count(r) * 1e0 / count(*) FROM cvl)")))
def clean_splits_same_share(spark, sf):
    """Training loses the share of rows that validation lost."""
    rows = K.clean_splits_by_target(ev(spark, sf), X.outlier_names(spark, sf), 0.97, 0.3)
    return rows.select("split", "name", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("job_15_clean_splits_by_threshold", sel(
    f"SELECT split, name, 0 AS negative FROM ev WHERE has_doc AND round(iou, 6) >= 0.99 UNION ALL SELECT n.split, n.name, 1 FROM (SELECT split, name, row_number() OVER "
    f"(PARTITION BY split ORDER BY {HASH}, name) AS rn FROM quad_samples WHERE {NEG}) n JOIN (SELECT split, CAST(round_even(np * ratio, 0) AS BIGINT) AS k FROM "
    f"(SELECT split, count(*) AS np FROM ev WHERE has_doc AND round(iou, 6) >= 0.99 GROUP BY split) a JOIN (SELECT split, count(*) FILTER (WHERE {NEG}) / "
    f"greatest(1, count(*) FILTER (WHERE NOT {NEG})) AS ratio FROM quad_samples GROUP BY split) b USING (split)) k ON n.split = k.split WHERE rn <= k", EV))
def clean_splits_by_threshold(spark, sf):
    evals = K.rounded_evals(K.full_evaluation(*base(spark, sf), "teacher"))
    return K.clean_splits_by_threshold(evals, X.samples(spark, sf), 0.99, SEED).select("split", "name", num(F.col("is_negative")).alias("negative"))


CAND = "o.has_doc AND n.has_doc AND round(o.iou, 6) < 0.99 AND round(n.iou, 6) >= 0.98"


def rounded_runs(spark, sf):
    return [K.rounded_evals(r) for r in runs(spark, sf)]


@query("job_16_expansion_candidates", sel(
    f"SELECT o.split, o.name, {q6('o.iou', 'iou_old')}, {q6('n.iou', 'iou_new')} FROM eo o JOIN en n ON o.sample_id = n.sample_id WHERE {CAND}", OLD_NEW))
def expansion_candidates(spark, sf):
    return K.expansion_candidates(*rounded_runs(spark, sf)).select("split", "name", "iou_old", "iou_new")


@query("job_25_iou_range_candidates", sel(
    f"SELECT split, name, {q6('coalesce(raw, 0)', 'iou')}, det AS teacher_detected FROM gv WHERE ok AND coalesce(raw, 0) >= 0.5 AND coalesce(raw, 0) < 0.9", GVT))
def iou_range_candidates(spark, sf):
    return K.iou_range_candidates(gvt(spark, sf), 0.5, 0.9).select("split", "name", r6("iou"), "teacher_detected")


@query("job_27_self_training_round", sel(
    f"SELECT split, name, 'clean' AS origin FROM eo WHERE has_doc AND round(iou, 6) >= 0.99 UNION ALL SELECT o.split, o.name, 'candidate' FROM eo o JOIN en n "
    f"ON o.sample_id = n.sample_id WHERE {CAND}", OLD_NEW))
def self_training_round(spark, sf):
    return K.self_training_round(*rounded_runs(spark, sf))


@query("job_27_round_progress", sel(
    f"SELECT o.split, count(*) AS n_evaluated, {q6('avg(o.iou)', 'mean_iou_old')}, {q6('avg(n.iou)', 'mean_iou_new')}, count(*) FILTER (WHERE round(o.iou, 6) >= 0.99) AS n_clean, "
    f"count(*) FILTER (WHERE {CAND}) AS n_candidates, count(*) FILTER (WHERE round(o.iou, 6) >= 0.99 OR ({CAND})) AS n_expanded FROM eo o JOIN en n "
    f"ON o.sample_id = n.sample_id WHERE o.has_doc GROUP BY o.split", OLD_NEW).replace("avg(o.iou)", "avg(round(o.iou, 6))").replace("avg(n.iou)", "avg(round(n.iou, 6))"))
def round_progress(spark, sf):
    old, new = [cut(r) for r in rounded_runs(spark, sf)]
    return rounded(K.round_progress(old, new, K.self_training_round(old, new)))


# ---------------------------------------------------------------- relabelling and import

KIND = ("CASE WHEN starts_with(lower(name), 'negative_') THEN 'negative' WHEN starts_with(lower(name), 'midv') THEN 'midv' "
        "WHEN starts_with(lower(name), 'smartdoc') THEN 'smartdoc' ELSE 'other_iou_ge' END")
REB = [*GVT, ("rb", (f"SELECT s.split, s.name, {KIND} AS kind, "
       + ", ".join(f"CASE WHEN p.detected = 1 AND NOT {NEG.replace('name', 's.name')} THEN p.c{i} END AS c{i}" for i in range(8)) + ", "
       f"CASE WHEN {NEG.replace('name', 's.name')} THEN 'empty' WHEN p.sample_id IS NULL THEN 'missing_pred' WHEN p.detected = 1 THEN 'written' ELSE 'empty' END AS label_status, "
       f"g.raw FROM quad_samples s LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id AND p.source = 'teacher' LEFT JOIN gv g ON s.sample_id = g.sample_id").replace(
           "lower(name)", "lower(s.name)"))]


def rebuilt(spark, sf):
    s, _, p = base(spark, sf)
    return L.rebuild_with_teacher_labels(s, gvt(spark, sf), p)


@query("job_17_rebuild_with_teacher_labels", sel(
    "SELECT split, name, kind, label_status, " + cols("c") + " FROM rb WHERE kind <> 'other_iou_ge' OR raw >= 0.97", REB))
def rebuild_with_teacher_labels(spark, sf):
    return rebuilt(spark, sf).select("split", "name", "kind", "label_status", *spread(F.col("coords"), "c"))


@query("ag_09_kept_breakdown", sel("SELECT split, kind, count(*) AS n FROM rb WHERE kind <> 'other_iou_ge' OR raw >= 0.97 GROUP BY split, kind", REB))
def kept_breakdown(spark, sf):
    return M.status_counts(rebuilt(spark, sf), "kind", ["split"])


def _sumdiff(p: str, out: str) -> str:
    s = [f"{p}{2*i} + {p}{2*i+1}" for i in range(4)]
    d = [f"{p}{2*i+1} - {p}{2*i}" for i in range(4)]
    plan = [(s, "least"), (d, "least"), (s, "greatest"), (d, "greatest")]
    return ", ".join(f"[{', '.join(f'{p}{2*j + a}' for j in range(4))}][list_position([{', '.join(k)}], {f}({', '.join(k)}))] AS {out}{2*i + a}"
                     for i, (k, f) in enumerate(plan) for a in (0, 1))


NC = [pairs_cte(), ("ns", f"SELECT pid, {_sumdiff('a', 'a')}, {_sumdiff('b', 'b')} FROM pr"), *iou_ctes("ni", "ns")]


def candidates(spark, sf):
    s, lab, p = base(spark, sf)
    known = s.where("sample_id % 3 = 0").select("name")
    return L.new_candidates(J.join_labels(s, lab, "inner").select("split", "name", "gt"), p, known)


@query("job_18_new_candidates", sel(
    f"SELECT s.name, CAST(s.sample_id % 3 = 0 AS INT) AS in_known, coalesce(p.detected, 0) AS detected, {q6('i.iou', 'iou')}, "
    f"CAST(s.sample_id % 3 <> 0 AND coalesce(i.iou >= 0.97, false) AS INT) AS is_new FROM quad_samples s LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id "
    f"AND p.source = 'teacher' LEFT JOIN ni i ON s.sample_id = i.pid WHERE s.g0 IS NOT NULL", NC))
def new_candidates(spark, sf):
    return candidates(spark, sf).select("name", "in_known", "detected", r6("iou"), num(F.col("is_new")).alias("is_new"))


@query("ag_19_annotation_counts", sel(
    "SELECT count(*) AS total, count(*) FILTER (WHERE s.sample_id % 3 = 0) AS in_known, count(*) FILTER (WHERE i.iou IS NOT NULL) AS detected_ok, "
    "count(*) FILTER (WHERE i.iou >= 0.97) AS iou_ge, count(*) FILTER (WHERE i.iou >= 0.97 AND s.sample_id % 3 <> 0) AS new_iou_ge FROM quad_samples s "
    "LEFT JOIN ni i ON s.sample_id = i.pid WHERE s.g0 IS NOT NULL", NC))
def annotation_counts(spark, sf):
    return candidates(spark, sf).agg(
        F.count("*").alias("total"), F.count_if(F.col("in_known") == 1).alias("in_known"), F.count_if(F.col("detected") == 1).alias("detected_ok"),
        F.count_if(F.col("iou") >= 0.97).alias("iou_ge"), F.count_if("is_new").alias("new_iou_ge"))


IMP = [("ip", "SELECT s.name, CASE WHEN z.sample_id IS NULL THEN 'missing_source_image' WHEN p.sample_id IS NULL THEN 'missing_teacher_pred' WHEN p.detected <> 1 THEN "
        "'teacher_not_ok' WHEN s.sample_id % 23 = 0 THEN 'missing_teacher_pred' WHEN s.sample_id % 11 = 0 THEN 'label_exists' ELSE 'written' END AS status FROM quad_samples s "
        f"LEFT JOIN image_sizes z ON s.sample_id = z.sample_id LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id AND p.source = 'teacher' WHERE NOT {NEG.replace('name', 's.name')}")]


def imported(spark, sf):
    """Some report rows are cut short (every 23rd), some labels exist already (every 11th)."""
    s, _, _ = base(spark, sf)
    p = X.predictions(spark, sf).where("source = 'teacher'")
    report = p.select("name", F.when(F.col("detected") == 1, "OK").otherwise("NO_DOCUMENT").alias("status"),
                      F.when(F.col("sample_id") % 23 == 0, F.slice("coords", 1, 4)).otherwise(F.col("coords")).alias("coords"))
    return L.import_candidates(s.where("NOT is_negative"), X.sizes(spark, sf).select("name"), report, s.where("sample_id % 11 = 0").select("name"))


@query("job_19_import_candidates", sel("SELECT name, status FROM ip", IMP))
def import_candidates(spark, sf):
    return imported(spark, sf).select("name", "status")


@query("ag_19_import_counts", sel("SELECT status, count(*) AS n FROM ip GROUP BY status", IMP))
def import_counts(spark, sf):
    return M.status_counts(imported(spark, sf))


@query("job_20_apply_review_deletions", sel("SELECT split, name FROM quad_samples WHERE sample_id % 13 <> 0"))
def apply_review_deletions(spark, sf):
    return W.apply_review_deletions(*index(spark, sf), X.samples(spark, sf)).select("split", "name")


@query("job_20_deletion_report", sel(
    "SELECT split, count(*) FILTER (WHERE sample_id % 5 <> 0) AS n_before, count(*) FILTER (WHERE sample_id % 5 <> 0 AND sample_id % 13 = 0) AS n_removed, "
    "count(*) FILTER (WHERE sample_id % 5 = 0 AND sample_id % 13 = 0) AS n_absent, count(*) FILTER (WHERE sample_id % 5 <> 0 AND sample_id % 13 <> 0) AS n_after FROM quad_samples GROUP BY split"))
def deletion_report(spark, sf):
    """Every fifth sample had left the splits before."""
    return W.deletion_report(*index(spark, sf), X.samples(spark, sf).where("sample_id % 5 <> 0"))


EMPTY = f"g0 IS NULL AND NOT {NEG} AND (name ILIKE 'id%' OR name ILIKE 'midv%')"


@query("job_21_remove_empty_annotations", sel(f"SELECT split, name FROM quad_samples WHERE NOT ({EMPTY})"))
def remove_empty_annotations(spark, sf):
    s, lab, _ = base(spark, sf)
    return L.remove_empty_annotations(s, lab, ["id", "MIDV"]).select("split", "name")


@query("ag_09_removal_counts", sel(f"SELECT split, lower(split_part(name, '_', 1)) AS token, count(*) AS n FROM quad_samples WHERE {EMPTY} GROUP BY 1, 2"))
def removal_counts(spark, sf):
    s, lab, _ = base(spark, sf)
    return M.status_counts(L.empty_annotations(s, lab, ["id", "MIDV"]), "token", ["split"])


def _relabel_sql() -> tuple[str, list]:
    ctes = [("rl", "SELECT s.sample_id, s.split, s.name, " + cols("g") + ", p.detected = 1 AS hit, " + ", ".join(f"p.c{i}" for i in range(8)) + " FROM quad_samples s LEFT JOIN "
             "quad_predictions p ON s.sample_id = p.sample_id AND p.source = 'docaligner' WHERE s.name ILIKE 'receipt%' OR s.name ILIKE 'book%'"),
            ("ro", ccw_sql("(SELECT * FROM rl WHERE hit)", "c", "d", "sample_id"))]
    # least sum of the four angle-ordered corners is the first corner of the new label
    s = [f"d{2*i} + d{2*i+1}" for i in range(4)]
    at = f"list_position([{', '.join(s)}], least({', '.join(s)}))"
    rolled = [f"[{', '.join(f'd{2*i + j % 2}' for i in range(4))}][({at} - 1 + {j // 2}) % 4 + 1]" for j in range(8)]
    x = ", ".join(f"CASE WHEN hit THEN least(greatest({r}, 0e0), 1e0) ELSE g{j} END AS x{j}" for j, r in enumerate(rolled))
    return (f"SELECT r.split, r.name, CASE WHEN hit THEN 'relabelled' ELSE 'not_detected' END AS status, {x} FROM rl r LEFT JOIN ro o ON r.sample_id = o.sample_id", ctes)


@query("job_22_relabel_by_prefix", sel(*_relabel_sql()))
def relabel_by_prefix(spark, sf):
    return L.relabel_by_prefix(*base(spark, sf), ["receipt", "book"]).select("split", "name", "status", *spread(F.col("coords"), "x"))


@query("job_22_relabel_only_if_empty", sel(
    "SELECT status, count(*) AS n FROM (SELECT CASE WHEN g0 IS NOT NULL THEN 'skipped_nonempty' WHEN p.detected = 1 THEN 'relabelled' ELSE 'not_detected' END AS status "
    "FROM quad_samples s LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id AND p.source = 'docaligner' WHERE s.name ILIKE 'receipt%' OR s.name ILIKE 'book%') z GROUP BY status"))
def relabel_only_if_empty(spark, sf):
    return M.status_counts(L.relabel_by_prefix(*base(spark, sf), ["receipt", "book"], only_if_empty=True))


@query("job_23_attach_model_labels", sel(
    "SELECT name[:-5] AS stem, 0 AS class, " + cols("g", "x") + " FROM quad_samples WHERE g0 IS NOT NULL UNION ALL SELECT name[:-5], 1, " + cols("c") + " FROM quad_predictions WHERE source = 'winner' AND detected = 1 "
    "AND conf >= 0.9 UNION ALL SELECT t.name[:-5], 1, " + cols("t.c") + " FROM quad_predictions t LEFT JOIN quad_predictions w ON t.sample_id = w.sample_id AND w.source = 'winner' AND w.detected = 1 "
    "AND w.conf >= 0.9 WHERE t.source = 'teacher' AND t.detected = 1 AND w.sample_id IS NULL"))
def attach_model_labels(spark, sf):
    """Existing class-1 lines come from the teacher; the winner's replace them where it is sure."""
    s, lab, p = base(spark, sf)
    hit = p.where("detected = 1").join(s.select("name", "stem"), "name")
    lines = lab.withColumn("class", F.lit(0)).unionByName(hit.where("source = 'teacher'").select("stem", "coords", F.lit(1).alias("class")))
    scored = hit.where("source = 'winner'").select("stem", "coords", F.col("conf").alias("score"))
    return L.attach_model_labels(lines, scored, 0.9).select("stem", "class", *spread(F.col("coords"), "x"))


# ---------------------------------------------------------------- review and scoring

@query("job_26_apply_review_state", sel(
    f"SELECT name, CAST(discarded AS INT) AS discarded, CAST(modified AS INT) AS modified, {q6('iou', 'iou')}, {q6('CASE WHEN has_gt THEN err_mean END', 'err_mean')} FROM rv", reviewed_ctes()))
def apply_review_state(spark, sf):
    return reviewed(spark, sf).select("name", num(F.col("discarded")).alias("discarded"), num(F.col("modified")).alias("modified"), r6("iou"), r6("err_mean"))


def _accept_sql() -> tuple[str, list]:
    c = ", ".join(f"c{i}" for i in range(8))
    ctes = [("ac", "SELECT seq, sample_id, shift, CASE WHEN action = 'modify' AND seq % 3 = 0 THEN 'accept' ELSE action END AS action FROM review_events"),
            ("ph", f"SELECT sample_id, {c}, CASE source WHEN 'teacher' THEN sample_id * 13 % 300 WHEN 'winner' THEN 300 + sample_id * 29 % 5000 ELSE 1000000000 END AS pseq FROM quad_predictions WHERE detected = 1"),
            ("lk", f"SELECT a.seq, a.sample_id, {c}, row_number() OVER (PARTITION BY a.seq ORDER BY pseq DESC) AS rn FROM ac a JOIN ph p ON p.sample_id = a.sample_id AND p.pseq < a.seq WHERE a.action = 'accept'"),
            ("ed", f"SELECT seq, sample_id, shift, {', '.join(f'NULL::DOUBLE AS c{i}' for i in range(8))} FROM ac WHERE action = 'modify' UNION ALL SELECT seq, sample_id, NULL, {c} FROM lk WHERE rn = 1"),
            ("le", f"SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY sample_id) AS n_edits FROM ed"),
            ("gs", "SELECT sample_id, coalesce(max_by(action, seq) FILTER (WHERE action IN ('discard', 'undiscard')) = 'discard', false) AS discarded FROM ac GROUP BY sample_id")]
    hit = "l.sample_id IS NOT NULL AND NOT coalesce(g.discarded, false)"
    e = ", ".join(f"CASE WHEN {hit} THEN coalesce(l.c{i}, g{i} + l.shift) ELSE g{i} END AS e{i}" for i in range(8))
    return (f"SELECT s.name, CAST(coalesce(g.discarded, false) AS INT) AS discarded, CAST({hit} AS INT) AS modified, coalesce(l.n_edits, 0) AS n_edits, {e} FROM quad_samples s "
            "LEFT JOIN gs g ON g.sample_id = s.sample_id LEFT JOIN le l ON l.sample_id = s.sample_id AND l.rn = 1 WHERE s.g0 IS NOT NULL", ctes)


@query("job_26_accept_prediction", sel(*_accept_sql()))
def accept_prediction(spark, sf):
    """Every third edit accepts the prediction shown then: of three versions the last one before the event; the third comes too late for all."""
    s, lab, _ = base(spark, sf)
    ev_ = events(spark, sf).withColumn("action", F.when((F.col("action") == "modify") & (F.col("seq") % 3 == 0), "accept").otherwise(F.col("action")))
    k = F.col("sample_id")
    shown = X.predictions(spark, sf).where("detected = 1").select(
        "name", F.when(F.col("source") == "teacher", 1).when(F.col("source") == "winner", 2).otherwise(3).alias("version"), "coords",
        F.when(F.col("source") == "teacher", k * 13 % 300).when(F.col("source") == "winner", k * 29 % 5000 + 300).otherwise(F.lit(1000000000)).alias("seq"))
    state = J.fold_events(J.accepted_predictions(ev_, shown))
    rows = J.effective_labels(J.join_labels(s, lab, "inner"), state).join(state.select("name", "n_edits"), "name", "left")
    return rows.select("name", num(F.col("discarded")).alias("discarded"), num(F.col("modified")).alias("modified"), F.coalesce("n_edits", F.lit(0)).alias("n_edits"), *spread(F.col("effective"), "e"))


@query("job_26_cleaned_split", sel("SELECT split, name FROM rv WHERE NOT discarded", reviewed_ctes()))
def cleaned_split(spark, sf):
    return W.cleaned_split(reviewed(spark, sf)).select("split", "name")


@query("job_26_edited_labels", sel(f"SELECT name, {', '.join(f'b{i} AS c{i}' for i in range(8))} FROM rv WHERE modified", reviewed_ctes()))
def edited_labels(spark, sf):
    return W.edited_labels(reviewed(spark, sf)).select("name", *spread(F.col("coords"), "c"))


def toy_predictor():
    """Stands in for a user's model: a box and a score that follow from the sample number."""
    def predict(batch):
        k = batch["sample_id"].to_numpy()
        x, y = (k % 97) / 1024.0, (k % 89) / 1024.0
        batch["coords"] = list(np.stack([x, y, x + 0.5, y, x + 0.5, y + 0.5, x, y + 0.5], axis=1))
        batch["score"] = (k % 64) / 64.0
        return batch
    return predict


SCORED = "split string, name string, is_negative boolean, sample_id bigint, coords array<double>, score double"


def scored(spark, sf):
    s = X.samples(spark, sf).select("split", "name", "is_negative", "sample_id")
    return scoring.score(s, toy_predictor, SCORED)


TOY = ["(sample_id % 97) / 1024e0" + " + 0.5e0" * (i in (2, 4)) if i % 2 == 0 else "(sample_id % 89) / 1024e0" + " + 0.5e0" * (i in (5, 7)) for i in range(8)]


@query("udf_01_score", sel("SELECT name, (sample_id % 64) / 64e0 AS score, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(TOY)) + " FROM quad_samples"))
def score(spark, sf):
    return scored(spark, sf).select("name", "score", *spread(F.col("coords"), "x"))


@query("job_28_pseudo_label_table", sel(
    f"SELECT split, name, CAST(NOT {NEG} AND sample_id % 64 >= 32 AS INT) AS detected, CASE WHEN NOT {NEG} AND sample_id % 64 >= 32 THEN (sample_id % 64) / 64e0 ELSE 0e0 END AS conf, "
    + ", ".join(f"CASE WHEN NOT {NEG} AND sample_id % 64 >= 32 THEN {x} ELSE -1e0 END AS x{i}" for i, x in enumerate(TOY)) + " FROM quad_samples"))
def pseudo_label_table(spark, sf):
    return scoring.pseudo_labels(scored(spark, sf), 0.5, G.order_tlbr_angle).select("split", "name", "detected", "conf", *spread(F.col("coords"), "x"))


def toy_decoder(contents):
    """Stands in for an image decoder: the length of each content; one that starts with a letter from a to e can't be opened."""
    sizes = [len(c) for c in contents]
    if any(c[:1] in b"abcde" and c for c in contents):
        raise ValueError("broken image")
    return [[float(n)] for n in sizes]


@query("udf_02_decode_images", "SELECT doc_id, CASE WHEN text IS NULL OR left(text, 1) IN ('a', 'b', 'c', 'd', 'e') THEN NULL ELSE CAST(octet_length(encode(text)) AS BIGINT) END AS n_bytes, "
       "CASE WHEN text IS NULL OR left(text, 1) IN ('a', 'b', 'c', 'd', 'e') THEN 'failed_open_image' ELSE 'ok' END AS status FROM documents")
def decode_images(spark, sf):
    """The decode hook over text bytes instead of image bytes; broken ones are rows with a status."""
    files = X.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    out = scoring.decode_images(files, toy_decoder, most_bytes=1 << 20)
    return out.select("doc_id", F.get("grid", F.lit(0)).cast("bigint").alias("n_bytes"), "status")
