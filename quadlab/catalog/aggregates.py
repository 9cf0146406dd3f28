"""AG-*: aggregations."""

from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.compare import bbox_sql, categorized, category_sql
from quadlab.catalog.geometry import CORNER_TESTS, LAB, TOUCH_TESTS, issue_rows
from quadlab.catalog.joins import STATE, base, events
from quadlab.catalog.shared import corner_err, evaluated_ctes, iou_ctes, q6, sel
from quadlab.functions import geometry as G, names as N
from quadlab.operators import joins as J, metrics as M
from quadlab.plans import cleaning as K, review as W

EV = evaluated_ctes()


def ev(spark, sf, source="teacher", exact_iou=True):
    s, lab, p = base(spark, sf)
    return K.evaluated(s, lab, p, source, exact_iou=exact_iou)


def rounded(df, digits=6):
    """Every double column rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CLS = ("count(*) FILTER (WHERE score > 0.5 AND has_doc) AS tp, count(*) FILTER (WHERE score > 0.5 AND NOT has_doc) AS fp, "
       "count(*) FILTER (WHERE score <= 0.5 AND NOT has_doc) AS tn, count(*) FILTER (WHERE score <= 0.5 AND has_doc) AS fn")


def cls_rates() -> str:
    prec, rec = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)"
    return (f"{q6('coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0)', 'cls_accuracy')}, {q6(prec, 'cls_precision')}, "
            f"{q6(rec, 'cls_recall')}, {q6(f'coalesce(2 * {prec} * {rec} / nullif({prec} + {rec}, 0), 0)', 'cls_f1')}")


def report_sql(by: str, where: str = "true") -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    rec = ", ".join(q6(f"coalesce(avg(CASE WHEN iou >= 0.{t} THEN 1e0 ELSE 0e0 END) FILTER (WHERE has_doc), 0)", f"recall_{t}") for t in (50, 75, 90, 95, 99))
    lt = ", ".join(f"count(*) FILTER (WHERE has_doc AND iou < 0.{t}) AS num_iou_lt_{t}" for t in (90, 95, 99))
    gt = ", ".join(f"count(*) FILTER (WHERE has_doc AND err_mean > {t}) AS num_err_gt_{t}" for t in (10, 20, 50))
    g = (f"SELECT {key}{CLS}, {q6('avg(iou) FILTER (WHERE has_doc)', 'mean_iou')}, "
         f"{q6('quantile_cont(iou, 0.5) FILTER (WHERE has_doc)', 'median_iou')}, {q6('avg(err_mean) FILTER (WHERE has_doc)', 'corner_error_px')}, "
         f"{q6('min(least(e0, e1, e2, e3)) FILTER (WHERE has_doc)', 'corner_error_min_px')}, "
         f"{q6('max(greatest(e0, e1, e2, e3)) FILTER (WHERE has_doc)', 'corner_error_max_px')}, {rec}, {lt}, {gt}, "
         f"count(*) AS num_samples, count(*) FILTER (WHERE has_doc) AS num_with_doc FROM ev WHERE {where} {group}")
    c = (f"SELECT {key}{q6('quantile_cont(e, 0.95)', 'corner_error_p95_px')} FROM (SELECT {key}unnest([e0, e1, e2, e3]) AS e FROM ev "
         f"WHERE has_doc AND {where}) u {group}")
    on = f"USING ({by})" if by else "ON true"
    return f"SELECT a.* EXCLUDE (tp, fp, tn, fn), {cls_rates()}, corner_error_p95_px FROM ({g}) a JOIN ({c}) c {on}"


@query("ag_01_detection_metrics", sel(report_sql("split"), EV))
def detection_metrics(spark, sf):
    return rounded(M.detection_metrics(ev(spark, sf), ["split"]))


@query("ag_01_detection_metrics_all", sel(report_sql(""), EV))
def detection_metrics_all(spark, sf):
    return rounded(M.detection_metrics(ev(spark, sf)))


@query("ag_02_classification_metrics", sel(f"SELECT split, tp, fp, tn, fn, {cls_rates()} FROM (SELECT split, {CLS} FROM ev GROUP BY split) z", EV))
def classification_metrics(spark, sf):
    s, lab, p = base(spark, sf)
    rows = J.join_predictions(J.join_labels(s, lab), p, "teacher").select(
        "split", (F.col("gt_valid") == 1).alias("has_doc"), (F.col("conf") * F.col("detected")).alias("score"))
    return rounded(M.classification_metrics(rows, ["split"]))


@query("ag_03_iou_summary", sel(
    "SELECT split, count(iou) AS n, " + ", ".join([
        q6("avg(iou)", "mean_iou"), q6("avg(CAST(iou < 0.5 AS INT))", "frac_lt_50"), q6("avg(CAST(iou < 0.1 AS INT))", "frac_lt_10"),
        q6("avg(CAST(iou >= 0.9 AS INT))", "recall_90"), q6("avg(CAST(iou >= 0.95 AS INT))", "recall_95"),
        q6("avg(err_mean)", "corner_err_mean_px"), q6("quantile_cont(iou, 0.5)", "median_iou"), q6("quantile_cont(iou, 0.01)", "p01_iou"),
        q6("quantile_cont(iou, 0.05)", "p05_iou"), q6("quantile_cont(err_mean, 0.95)", "corner_err_p95_px")])
    + " FROM ev WHERE has_doc GROUP BY split", EV))
def iou_summary(spark, sf):
    return rounded(M.iou_summary(ev(spark, sf).where("has_doc"), ["split"]))


@query("ag_04_percentile_profile", sel(
    "SELECT split, count(iou) AS n, " + ", ".join([q6("avg(iou)", "mean"), q6("min(iou)", "min"), q6("max(iou)", "max")]
    + [q6(f"quantile_cont(iou, {p / 100})", f"p{p:02d}") for p in (1, 5, 10, 25, 50, 75, 95)]) + " FROM ev WHERE has_doc GROUP BY split", EV))
def percentile_profile(spark, sf):
    return rounded(M.percentile_profile(ev(spark, sf).where("has_doc"), by=["split"]))


L1 = "(" + " + ".join(f"abs(c{i} - g{i})" for i in range(8)) + ") * 28e0"


@query("ag_05_extended_metrics", sel(
    "SELECT split, count(*) FILTER (WHERE has_doc) AS pos_count, count(*) FILTER (WHERE NOT has_doc) AS neg_count, " + ", ".join([
        q6("avg(bb)", "mean_iou"), q6("avg(l1)", "mean_err"), q6("avg(CAST((score >= 0.5) = has_doc AS INT))", "score_acc"),
        q6("coalesce(avg(score) FILTER (WHERE has_doc), 0)", "score_pos_mean"), q6("coalesce(avg(score) FILTER (WHERE NOT has_doc), 0)", "score_neg_mean")]
        + [q6(f"quantile_cont({c}, {p})", f"{n}_{t}") for c, t in (("bb", "iou"), ("l1", "err"))
           for p, n in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))])
    + f" FROM (SELECT *, CASE WHEN has_doc THEN {bbox_sql('c', 'g', '1e-9')} END AS bb, CASE WHEN has_doc THEN {L1} END AS l1 FROM ev) z GROUP BY split", EV))
def extended_metrics(spark, sf):
    return rounded(M.extended_metrics(ev(spark, sf, exact_iou=False), ["split"]))


@query("ag_06_split_summary", sel(
    "SELECT split, count(*) AS n, " + ", ".join(q6(f"{f}({c})", f"{p}_{n}") for c, p in (("iou", "iou"), ("err_mean", "err"))
                                              for f, n in (("avg", "mean"), ("min", "min"), ("max", "max")))
    + ", count(*) FILTER (WHERE iou < 0.9) AS n_iou_lt_90, count(*) FILTER (WHERE iou < 0.8) AS n_iou_lt_80 FROM ev WHERE has_doc GROUP BY split", EV))
def split_summary(spark, sf):
    return rounded(M.split_summary(ev(spark, sf).where("has_doc")))


@query("ag_07_category_distribution", sel(
    f"SELECT category, count(*) AS n, {q6('count(*) * 100e0 / sum(count(*)) OVER ()', 'pct')} FROM (SELECT {category_sql()} AS category FROM ev) z GROUP BY category", EV))
def category_distribution(spark, sf):
    return rounded(M.category_distribution(categorized(spark, sf)))


@query("ag_07_iou_stats", sel(
    "SELECT count(iou) AS n, " + ", ".join([q6("avg(iou)", "mean"), q6("min(iou)", "min"), q6("max(iou)", "max"), q6("stddev_pop(iou)", "std"),
                                           q6("quantile_cont(iou, 0.5)", "median")])
    + ", " + ", ".join(f"count(*) FILTER (WHERE iou >= 0.{t}) AS n_ge_{t}" for t in (50, 70, 90)) + " FROM ev WHERE has_doc", EV))
def iou_stats(spark, sf):
    return rounded(M.iou_stats(ev(spark, sf).where("has_doc")))


@query("ag_08_issue_counts", sel(
    f"SELECT split_part(issue, ':', 1) AS issue_type, count(*) AS n_issues, count(DISTINCT sample_id) AS n_names FROM "
    f"({issue_rows(CORNER_TESTS + TOUCH_TESTS, LAB)}) i GROUP BY 1"))
def issue_counts(spark, sf):
    q = F.col("coords")
    rows = X.labels(spark, sf).select("name", F.explode(F.concat(G.corner_order_issues(q), G.edge_touch_issues(q))).alias("issue"))
    return M.issue_counts(rows.withColumn("issue_type", N.issue_type(F.col("issue"))))


@query("ag_09_counts_by_prefix", sel(
    "SELECT split, split_part(name, '_', 1) || '_' || split_part(name, '_', 2) AS prefix, count(*) AS n FROM quad_samples WHERE g0 IS NOT NULL GROUP BY 1, 2"))
def counts_by_prefix(spark, sf):
    s, lab, _ = base(spark, sf)
    return (J.join_labels(s, lab, "inner").groupBy("split", N.source_prefix(F.col("name")).alias("prefix")).agg(F.count("*").alias("n")))


@query("ag_10_duplicate_groups", sel(
    "SELECT * FROM (SELECT h, sample_id, count(*) OVER (PARTITION BY h) AS group_size FROM doc_hashes) z WHERE group_size > 1"))
def duplicate_groups(spark, sf):
    return M.duplicate_groups(X.doc_hashes(spark, sf), "h", "sample_id")


@query("ag_12_iou_histogram", sel(
    "SELECT split, count(iou) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (
        ("b99", "iou >= 0.99"), ("b98", "iou >= 0.98 AND iou < 0.99"), ("b97", "iou >= 0.97 AND iou < 0.98"), ("b95", "iou >= 0.95 AND iou < 0.97"),
        ("blow", "iou < 0.95"), ("ge99", "iou >= 0.99"), ("ge98", "iou >= 0.98"), ("ge97", "iou >= 0.97"), ("ge95", "iou >= 0.95")))
    + ", " + ", ".join(q6(f"100e0 * count(*) FILTER (WHERE iou >= 0.{t}) / count(iou)", f"ge{t}_pct") for t in (99, 98, 97, 95))
    + " FROM ev WHERE has_doc GROUP BY split", EV))
def iou_histogram(spark, sf):
    return rounded(M.iou_histogram(ev(spark, sf).where("has_doc"), ["split"]))


def reviewed(spark, sf, source="teacher"):
    """Samples with label, prediction (zero quad when absent) and review state applied."""
    s, lab, p = base(spark, sf)
    rows = J.join_predictions(J.join_labels(s, lab), p, source)
    rows = rows.withColumn("pred", F.coalesce("pred", F.array_repeat(F.lit(0.0), 8)))
    return W.apply_review_state(rows, J.fold_events(events(spark, sf)))


def reviewed_ctes(source="teacher") -> list:
    """rv: effective label b0..b7 after review, its IoU and errors against the source."""
    edit = "st.shift IS NOT NULL AND NOT st.discarded AND s.g0 IS NOT NULL"
    b = ", ".join(f"CASE WHEN {edit} THEN s.g{i} + st.shift ELSE s.g{i} END AS b{i}" for i in range(8))
    c = ", ".join(f"CASE WHEN p.detected = 1 THEN p.c{i} ELSE 0e0 END AS a{i}" for i in range(8))
    rows = (f"SELECT s.sample_id AS pid, s.split, s.name, starts_with(s.name, 'negative_') AS is_negative, s.g0 IS NOT NULL AS has_gt, "
            f"coalesce(p.detected, 0) AS detected, coalesce(st.discarded, false) AS discarded, coalesce({edit}, false) AS modified, {b}, {c} "
            f"FROM quad_samples s LEFT JOIN st ON s.sample_id = st.sample_id LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id AND p.source = '{source}'")
    e = ", ".join(f"{x} AS e{i}" for i, x in enumerate(corner_err("a", "b")))
    return [*STATE, ("rx", rows), ("rp", "SELECT * FROM rx WHERE has_gt AND detected = 1"), *iou_ctes("ri", "rp"),
            ("rv", f"SELECT x.*, CASE WHEN has_gt THEN coalesce(i.iou, 0e0) END AS iou, (e0 + e1 + e2 + e3) / 4e0 AS err_mean FROM "
                   f"(SELECT *, {e} FROM rx) x LEFT JOIN ri i ON x.pid = i.pid")]


def _dash_sql() -> str:
    live = "has_gt AND NOT is_negative AND NOT discarded"

    def block(c: str, tag: str) -> str:
        f = f"FILTER (WHERE {live})"
        return ", ".join([q6(f"avg({c}) {f}", f"mean_iou{tag}"), q6(f"100 * avg(CAST({c} >= 0.95 AS INT)) {f}", f"recall_95{tag}"),
                          q6(f"100 * avg(CAST({c} >= 0.9 AS INT)) {f}", f"recall_90{tag}"), f"count(*) FILTER (WHERE {live} AND {c} < 0.5) AS failed{tag}"])
    return (f"SELECT count(*) FILTER (WHERE {live}) AS n_positive, {block('iou', '')}, {q6(f'avg(err_mean) FILTER (WHERE {live})', 'mean_err')}, "
            f"count(*) FILTER (WHERE {live} AND err_mean > 10) AS high_error, {block('iou_b', '_b')}, count(*) FILTER (WHERE modified) AS n_modified, "
            f"count(*) FILTER (WHERE discarded) AS n_discarded, {q6(f'avg(iou_b) FILTER (WHERE {live}) - avg(iou) FILTER (WHERE {live})', 'delta_mean_iou')} "
            f"FROM (SELECT rv.*, w.iou AS iou_b FROM rv LEFT JOIN wi w ON rv.pid = w.pid) z")


@query("ag_13_review_dashboard", sel(_dash_sql(), [
    *reviewed_ctes(), ("wp", "SELECT x.pid, " + ", ".join(f"p.c{i} AS a{i}, x.b{i}" for i in range(8)) + " FROM rx x JOIN quad_predictions p "
                       "ON x.pid = p.sample_id AND p.source = 'winner' AND p.detected = 1 WHERE x.has_gt"), *iou_ctes("wi", "wp")]))
def review_dashboard(spark, sf):
    from quadlab.functions.overlap import with_polygon_iou
    s, lab, p = base(spark, sf)
    # both models in one pivot
    wide = J.join_sources(J.join_labels(s, lab), p, ["teacher", "winner"]).withColumn("pred", F.coalesce("teacher", F.array_repeat(F.lit(0.0), 8)))
    rows = W.apply_review_state(wide, J.fold_events(events(spark, sf)))
    rows = with_polygon_iou(rows, [("winner", "gt", "iou_b")])
    rows = rows.withColumn("has_doc", ~F.col("is_negative") & F.col("gt").isNotNull())
    return rounded(M.review_dashboard(rows))


@query("ag_14_latency_summary", sel(
    f"SELECT model, count(*) AS n, {q6('avg(ms)', 'mean_ms')}, {q6('quantile_cont(ms, 0.5)', 'p50_ms')}, {q6('quantile_cont(ms, 0.95)', 'p95_ms')} FROM latency_runs GROUP BY model"))
def latency_summary(spark, sf):
    return rounded(M.latency_summary(X.latency_runs(spark, sf)))


NEG = "starts_with(name, 'negative_')"


@query("ag_15_negative_ratio", sel(
    f"SELECT split, count(*) FILTER (WHERE NOT {NEG}) AS n_pos, count(*) FILTER (WHERE {NEG}) AS n_neg, "
    f"{q6(f'count(*) FILTER (WHERE {NEG}) / greatest(1, count(*) FILTER (WHERE NOT {NEG}))', 'neg_ratio')} FROM quad_samples GROUP BY split"))
def negative_ratio(spark, sf):
    return rounded(M.negative_ratio(X.samples(spark, sf)))


@query("ag_16_confidence_summary", sel(
    "SELECT source, count(*) AS processed, sum(detected)::BIGINT AS n_detected, " + ", ".join([
        q6("avg(conf) FILTER (WHERE detected = 1)", "conf_mean"), q6("quantile_cont(conf, 0.5) FILTER (WHERE detected = 1)", "conf_p50"),
        q6("quantile_cont(conf, 0.95) FILTER (WHERE detected = 1)", "conf_p95")]) + " FROM quad_predictions GROUP BY source"))
def confidence_summary(spark, sf):
    return rounded(M.confidence_summary(X.predictions(spark, sf)))


def model_runs(spark, sf):
    """Bounding-box metrics of every source on every split: (model, dataset, mean_iou, ...)."""
    s, lab, p = base(spark, sf)
    rows = J.join_labels(s, lab, "inner").join(p.where(F.col("detected") == 1).select("split", "name", "source", F.col("coords").alias("pred")), ["split", "name"])
    rows = M.evaluate_pairs(rows, exact_iou=False)
    agg = rows.groupBy(F.col("source").alias("model"), F.col("split").alias("dataset")).agg(
        F.avg("iou").alias("mean_iou"), F.avg((F.col("iou") >= 0.95).cast("double")).alias("recall_95"),
        F.avg((F.col("iou") >= 0.99).cast("double")).alias("recall_99"))
    return agg, rows


RUNS = [("mr", "SELECT p.source AS model, s.split AS dataset, s.sample_id, " + ", ".join(f"p.c{i} AS a{i}, s.g{i} AS b{i}" for i in range(8))
         + " FROM quad_samples s JOIN quad_predictions p ON s.sample_id = p.sample_id WHERE p.detected = 1 AND s.g0 IS NOT NULL"),
        ("mm", f"SELECT model, dataset, avg(bb) AS mean_iou, avg(CAST(bb >= 0.95 AS INT)) AS recall_95, avg(CAST(bb >= 0.99 AS INT)) AS recall_99 "
               f"FROM (SELECT model, dataset, {bbox_sql('a', 'b')} AS bb FROM mr) z GROUP BY model, dataset")]


@query("ag_17_worst_case_across_datasets", sel(
    f"SELECT model, {q6('min(mean_iou)', 'worst_mean_iou')}, count(*) AS n_datasets, CAST(rank() OVER (ORDER BY min(mean_iou) DESC) AS INT) AS rank FROM mm GROUP BY model", RUNS))
def worst_case_across_datasets(spark, sf):
    return rounded(M.worst_case_across_datasets(model_runs(spark, sf)[0]))


@query("ag_18_split_profile", sel(
    f"SELECT split, count(*) AS n, count(*) FILTER (WHERE NOT {NEG}) AS positives, count(*) FILTER (WHERE {NEG}) AS negatives, "
    f"count(*) FILTER (WHERE sample_id % 17 = 0 AND NOT {NEG}) AS outliers FROM quad_samples GROUP BY split"))
def split_profile(spark, sf):
    return M.split_profile(J.with_membership(X.samples(spark, sf), X.outlier_names(spark, sf), "is_outlier"))


@query("ag_20_target_check", sel(
    f"SELECT split, {q6('m', 'mean_iou')}, {q6('e', 'corner_error_px')}, CAST(m >= 0.9 AS INT) AS iou_ok, CAST(e <= 20 AS INT) AS err_ok, "
    f"CAST(m >= 0.9 AND e <= 20 AS INT) AS passed FROM (SELECT split, avg(iou) AS m, avg(err_mean) AS e FROM ev WHERE has_doc GROUP BY split) z", EV))
def target_check(spark, sf):
    m = ev(spark, sf).where("has_doc").groupBy("split").agg(*M.geometry_aggs(F.col("has_doc"))).select("split", "mean_iou", "corner_error_px")
    return rounded(M.target_check(m, 0.9, 20.0))
