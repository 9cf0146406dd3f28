"""JN-*: joins."""

from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.shared import cols, evaluated_ctes, iou_ctes, num, pairs_cte, q6, r6, sel, spread
from quadlab.operators import joins as J
from quadlab.plans import audit as A, cleaning as K


def base(spark, sf):
    return X.samples(spark, sf), X.labels(spark, sf).select("stem", "coords"), X.predictions(spark, sf).drop("sample_id")


@query("jn_01_samples_labels", sel("SELECT split, name, CAST(g0 IS NOT NULL AS INT) AS gt_valid, " + cols("g") + " FROM quad_samples"))
def samples_labels(spark, sf):
    s, lab, _ = base(spark, sf)
    return J.join_labels(s, lab).select("split", "name", "gt_valid", *spread(F.col("gt"), "g"))


@query("jn_01_samples_labels_inner", sel("SELECT split, name, " + cols("g") + " FROM quad_samples WHERE g0 IS NOT NULL"))
def samples_labels_inner(spark, sf):
    s, lab, _ = base(spark, sf)
    return J.join_labels(s, lab, "inner").select("split", "name", *spread(F.col("gt"), "g"))


@query("jn_02_samples_predictions", sel(
    "SELECT s.split, s.name, coalesce(p.detected, 0) AS detected, coalesce(p.conf, 0e0) AS conf, CAST(p.sample_id IS NOT NULL AS INT) AS has_row, "
    + ", ".join(f"CASE WHEN p.detected = 1 THEN c{i} END AS c{i}" for i in range(8)) + " FROM quad_samples s LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id AND p.source = 'teacher'"))
def samples_predictions(spark, sf):
    s, _, p = base(spark, sf)
    return J.join_predictions(s, p, "teacher").select("split", "name", "detected", "conf", "has_row", *spread(F.col("pred"), "c"))


@query("jn_03_n_sources", sel(
    "SELECT s.split, s.name, CAST(s.g0 IS NOT NULL AS INT) AS gt_valid, " + ", ".join(
        ", ".join(f"max(CASE WHEN source = '{n}' THEN c{i} END) AS {n}{i}" for i in range(8)) + f", max(CASE WHEN source = '{n}' THEN conf END) AS {n}_conf"
        for n, _ in X.SOURCE_ROWS)
    + ", count(p.sample_id) AS n_sources FROM quad_samples s LEFT JOIN (SELECT * FROM quad_predictions WHERE detected = 1) p "
      "ON s.sample_id = p.sample_id GROUP BY ALL"))
def n_sources(spark, sf):
    s, lab, p = base(spark, sf)
    rows = J.join_sources(J.join_labels(s, lab), p)
    names = [n for n, _ in X.SOURCE_ROWS]
    return rows.select("split", "name", "gt_valid", *[c for n in names for c in spread(F.col(n), n)], *[f"{n}_conf" for n in names],
                       sum((F.col(n).isNotNull().cast("bigint") for n in names), F.lit(0)).alias("n_sources"))


PAIR = ("pr", "SELECT a.sample_id * 16 + CASE WHEN a.source = 'docaligner' AND b.source = 'teacher' THEN 0 WHEN a.source = 'docaligner' THEN 1 "
        "ELSE 2 END AS pid, a.name, a.source AS source_a, b.source AS source_b, " + ", ".join(f"a.c{i} AS a{i}, b.c{i} AS b{i}" for i in range(8))
        + " FROM quad_predictions a JOIN quad_predictions b ON a.sample_id = b.sample_id AND a.source < b.source WHERE a.detected = 1 AND b.detected = 1")


@query("jn_04_pairwise_iou", sel(
    f"SELECT p.name, source_a, source_b, CASE WHEN aa > 0 AND ba > 0 THEN round(iou, 6) END AS iou FROM pr p JOIN i ON p.pid = i.pid",
    [PAIR, *iou_ctes("i", "pr", "ccw")]))
def pairwise_iou(spark, sf):
    return J.pairwise_iou(base(spark, sf)[2]).select("name", "source_a", "source_b", r6("iou"))


@query("jn_05_flagged_audit", sel(
    f"SELECT s.split, s.name, CAST(z.w IS NOT NULL AND coalesce(p.detected, 0) = 1 AS INT) AS teacher_detected, "
    f"CASE WHEN z.w IS NULL THEN 0e0 ELSE coalesce(p.conf, 0e0) END AS teacher_conf, {q6('i.iou', 'teacher_iou')} "
    f"FROM quad_samples s LEFT JOIN image_sizes z ON s.sample_id = z.sample_id LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id "
    f"AND p.source = 'teacher' LEFT JOIN i ON s.sample_id = i.pid AND z.w IS NOT NULL WHERE s.g0 < 0.15", [pairs_cte(), *iou_ctes("i", "pr")]))
def flagged_audit(spark, sf):
    s, lab, p = base(spark, sf)
    flagged = J.join_labels(s, lab, "inner").where(F.get("gt", F.lit(0)) < 0.15)
    audit = A.audit_table(A.teacher_audit(s, lab, p, X.sizes(spark, sf)))
    return J.join_audit(flagged, audit).select("split", "name", num(F.col("teacher_detected")).alias("teacher_detected"),
                                               "teacher_conf", r6("teacher_iou"))


OLD_NEW = [*evaluated_ctes("teacher", "eo"), *evaluated_ctes("winner", "en")]


def runs(spark, sf):
    s, lab, p = base(spark, sf)
    return K.full_evaluation(s, lab, p, "teacher"), K.full_evaluation(s, lab, p, "winner")


@query("jn_06_old_new_runs", sel(
    f"SELECT o.split, o.name, {q6('o.iou', 'iou_old')}, {q6('n.iou', 'iou_new')} FROM eo o JOIN en n ON o.split = n.split AND o.name = n.name "
    f"WHERE o.has_doc", OLD_NEW))
def old_new_runs(spark, sf):
    return J.join_runs(*runs(spark, sf)).select("split", "name", r6("iou_old"), r6("iou_new"))


@query("jn_07_without_names", sel("SELECT split, name FROM quad_samples WHERE sample_id % 17 <> 0"))
def without_names(spark, sf):
    return J.without_names(X.samples(spark, sf), X.outlier_names(spark, sf)).select("split", "name")


@query("jn_07_without_name_variants", sel("SELECT split, name FROM quad_samples WHERE sample_id % 17 <> 0"))
def without_name_variants(spark, sf):
    removed = X.outlier_names(spark, sf).select(F.concat(F.lit("images/"), "name").alias("name"))
    return J.without_name_variants(X.samples(spark, sf), removed).select("split", "name")


@query("jn_08_only_names", sel("SELECT split, name FROM quad_samples WHERE sample_id % 17 = 0"))
def only_names(spark, sf):
    return J.only_names(X.samples(spark, sf), X.outlier_names(spark, sf)).select("split", "name")


@query("jn_09_membership", sel("SELECT split, name, CAST(sample_id % 17 = 0 AS INT) AS is_outlier FROM quad_samples"))
def membership(spark, sf):
    return J.with_membership(X.samples(spark, sf), X.outlier_names(spark, sf), "is_outlier").select("split", "name", "is_outlier")


@query("jn_10_pick_image", sel(
    "SELECT s.sample_id, min_by(i.ext, i.priority) AS ext FROM quad_samples s JOIN quad_images i ON s.sample_id = i.sample_id "
    "WHERE s.g0 IS NOT NULL GROUP BY s.sample_id"))
def pick_image(spark, sf):
    return J.pick_image(X.labels(spark, sf), X.images(spark, sf).select("stem", "ext")).select("sample_id", "ext")


def index(spark, sf):
    """Review index and the overlays that still exist (every 13th was deleted)."""
    rows = X.samples(spark, sf).select("split", "name", "is_negative", "sample_id",
                                       F.concat("split", F.lit("/"), "stem", F.lit(".png")).alias("overlay_rel"))
    return rows.drop("sample_id"), rows.where("sample_id % 13 <> 0").select("overlay_rel")


@query("jn_11_deleted_overlays", sel("SELECT split, name FROM quad_samples WHERE sample_id % 13 = 0"))
def deleted_overlays(spark, sf):
    return J.deleted_overlays(*index(spark, sf)).select("split", "name")


def events(spark, sf):
    """Review events with edited quads: the label moved by the event's shift, where there is a label."""
    e = X.review_events(spark, sf)
    lab = X.labels(spark, sf).select("name", F.col("coords").alias("g"))
    moved = F.transform("g", lambda c: c + F.col("shift"))
    return e.join(lab, "name", "left").select("seq", "name", "action", F.when(F.col("action") == "modify", moved).alias("coords"))


STATE = [("st", "SELECT sample_id, coalesce(max_by(action, seq) FILTER (WHERE action <> 'modify') = 'discard', false) AS discarded, "
          "max_by(shift, seq) FILTER (WHERE action = 'modify') AS shift, count(*) FILTER (WHERE action = 'modify') AS n_edits "
          "FROM review_events GROUP BY sample_id")]


@query("jn_12_effective_labels", sel(
    "SELECT s.name, CAST(coalesce(st.discarded, false) AS INT) AS discarded, CAST(st.shift IS NOT NULL AND NOT st.discarded AS INT) AS modified, "
    + ", ".join(f"CASE WHEN st.shift IS NOT NULL AND NOT st.discarded THEN g{i} + st.shift ELSE g{i} END AS e{i}" for i in range(8)) + " FROM quad_samples s LEFT JOIN st "
    "ON s.sample_id = st.sample_id WHERE s.g0 IS NOT NULL", STATE).replace("st.shift IS NOT NULL AND NOT st.discarded AS INT",
                                                                        "coalesce(st.shift IS NOT NULL AND NOT st.discarded, false) AS INT"))
def effective_labels(spark, sf):
    s, lab, _ = base(spark, sf)
    rows = J.effective_labels(J.join_labels(s, lab, "inner"), J.fold_events(events(spark, sf)))
    return rows.select("name", num(F.col("discarded")).alias("discarded"), num(F.col("modified")).alias("modified"),
                       *spread(F.col("effective"), "e"))


@query("jn_13_two_models", sel(
    f"SELECT o.name, {q6('o.iou', 'iou_a')}, {q6('n.iou', 'iou_b')}, {q6('n.iou - o.iou', 'delta')} FROM eo o JOIN en n "
    f"ON o.sample_id = n.sample_id WHERE o.has_doc", OLD_NEW))
def two_models(spark, sf):
    s, lab, p = base(spark, sf)
    rows = J.compare_sources(J.join_labels(s, lab, "inner"), p, "teacher", "winner")
    return rows.select("name", r6("iou_a"), r6("iou_b"), r6("delta"))


@query("jn_14_label_diff", sel(
    f"SELECT p.name, CASE WHEN aa > 0 AND ba > 0 THEN round(iou, 6) + 0e0 END AS iou_old_new FROM pr p JOIN i ON p.pid = i.pid WHERE p.conf >= 0.9",
    [pairs_cte(), *iou_ctes("i", "pr", "ccw")]))
def label_diff(spark, sf):
    """Labels before and after they are replaced by confident teacher predictions."""
    s, lab, p = base(spark, sf)
    new = p.where((F.col("source") == "teacher") & (F.col("detected") == 1) & (F.col("conf") >= 0.9)).select("name", "coords", "conf")
    before = X.labels(spark, sf).select("name", "coords")
    return J.label_diff(before, new, new.select("name", "conf")).select("name", r6("iou_old_new"))


def precision_runs(spark, sf):
    """Latency events as runs of one model each in two precisions."""
    e = X.table(spark, sf, "events")
    runs = e.select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 2 == 0, "float16").otherwise("int8").alias("precision"),
                    "value", "event_id")
    return runs.groupBy("model", "precision").agg(F.avg((F.col("event_id") % 1000) / 1000.0).alias("mean_iou"), F.avg("value").alias("ms"))


@query("jn_15_paired_runs",
       "WITH r AS (SELECT event_type AS model, event_id % 2 AS p, avg((event_id % 1000) / 1000.0) AS iou, avg(value) AS ms FROM events GROUP BY 1, 2) "
       f"SELECT a.model, {q6('b.iou - a.iou', 'delta_iou')}, {q6('a.ms / b.ms', 'speedup')} FROM r a JOIN r b ON a.model = b.model AND a.p = 0 AND b.p = 1")
def paired_runs(spark, sf):
    return J.paired_runs(precision_runs(spark, sf), "float16", "int8").select("model", r6("delta_iou"), r6("speedup"))
