"""WN-*: ranking, cuts, top-k and paging."""

from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.aggregates import EV, RUNS, ev, model_runs, reviewed, reviewed_ctes, rounded
from quadlab.catalog.compare import category_sql, categorized
from quadlab.catalog.geometry import angle_sql
from quadlab.catalog.shared import corner_err, num, q6, r6, sel
from quadlab.checkpoints import cut
from quadlab.operators import ranking as R
from quadlab.operators.quantiles import aggregate, percentile


def positives(spark, sf):
    return ev(spark, sf).where("has_doc").select("split", "name", "iou", "err_mean", "detected")


def drop_sql(target: float, cap: float) -> str:
    """Row r is dropped when the rule does not yet hold before it: mean of rows r.. below target, r-1 within the cap."""
    return (f"SELECT name, CAST(coalesce(suffix / cnt < {target} AND (rn - 1) / n <= {cap}, false) AS INT) AS dropped FROM (SELECT name, "
            f"row_number() OVER w AS rn, count(*) OVER () * 1e0 AS n, sum(iou) OVER (ORDER BY iou DESC, name DESC) AS suffix, "
            f"row_number() OVER (ORDER BY iou DESC, name DESC) AS cnt FROM ev WHERE has_doc WINDOW w AS (ORDER BY iou, name)) z")


@query("wn_01_drop_min_until_mean", sel(drop_sql(0.95, 0.5), EV))
def drop_min_until_mean(spark, sf):
    return R.drop_min_until_mean(cut(positives(spark, sf)), 0.95, 0.5).select("name", num(F.col("dropped")).alias("dropped"))


@query("wn_01_drop_min_until_cap", sel(drop_sql(0.99, 0.1), EV))
def drop_min_until_cap(spark, sf):
    """The cap stops it: one row more than the cap goes."""
    return R.drop_min_until_mean(cut(positives(spark, sf)), 0.99, 0.1).select("name", num(F.col("dropped")).alias("dropped"))


@query("wn_02_drop_top_fraction", sel(
    "SELECT name, CAST(coalesce(rn <= floor(0.1 * n) OR e > 30, false) AS INT) AS dropped FROM (SELECT name, e, row_number() OVER "
    "(ORDER BY e DESC NULLS LAST, name) AS rn, count(e) OVER () AS n FROM (SELECT name, CASE WHEN substr(md5(name), 1, 1) NOT IN ('0', '1') THEN err_mean END AS e "
    "FROM ev WHERE has_doc)) z", EV))
def drop_top_fraction(spark, sf):
    """One row in sixteen has no error, another one an error that is not a number."""
    first = F.substring(F.md5("name"), 1, 1)
    err = F.when(first == "1", F.lit(float("nan"))).when(first != "0", F.col("err_mean"))
    rows = cut(positives(spark, sf).withColumn("err_mean", err))
    return R.drop_top_fraction(rows, 0.1, threshold=30.0).select("name", num(F.col("dropped")).alias("dropped"))


@query("wn_03_lowest_highest_k", sel(
    f"SELECT 'low' AS part, name, {q6('iou', 'iou')} FROM (SELECT * FROM ev WHERE has_doc ORDER BY iou, name LIMIT 100) a UNION ALL "
    f"SELECT 'high' AS part, name, {q6('err_mean', 'iou')} FROM (SELECT * FROM ev WHERE has_doc ORDER BY err_mean DESC, name LIMIT 100) b", EV))
def lowest_highest_k(spark, sf):
    rows = positives(spark, sf)
    low = R.lowest_k(rows, 100).select(F.lit("low").alias("part"), "name", r6("iou"))
    return low.unionByName(R.highest_k(rows, 100, "err_mean").select(F.lit("high").alias("part"), "name", r6("err_mean", "iou")))


@query("wn_04_top_n_per_group", sel(
    f"SELECT category, name, CAST(rn AS INT) AS rn FROM (SELECT category, name, row_number() OVER (PARTITION BY category ORDER BY err_mean, name) AS rn "
    f"FROM (SELECT *, {category_sql()} AS category FROM ev WHERE has_doc) z) y WHERE rn <= 20", EV))
def top_n_per_group(spark, sf):
    rows = categorized(spark, sf).where("has_doc").select("category", "name", "err_mean")
    return R.top_n_per_group(rows, 20, ["category"], ["err_mean", "name"]).select("category", "name", "rn")


@query("wn_05_paginate", sel(
    "SELECT name, rn, (rn - 1) // 24 + 1 AS page, ((rn - 1) % 24) // 6 AS grid_row, (rn - 1) % 6 AS grid_col, "
    "CAST(ceil(n / 24) AS BIGINT) AS n_pages FROM (SELECT name, row_number() OVER (ORDER BY name) AS rn, count(*) OVER () AS n FROM quad_samples) z"))
def paginate(spark, sf):
    return R.paginate(X.samples(spark, sf).select("name"), 24, 6, ["name"])


def hard_sql(hard: str) -> str:
    lists = (f"SELECT name, 0 AS prio, iou AS key FROM ({hard}) h UNION ALL SELECT name, 1, -score FROM ev WHERE NOT has_doc AND score >= 0.5 "
             f"UNION ALL SELECT name, 2, score FROM ev WHERE has_doc AND score < 0.5")
    return (f"SELECT name, CAST(prio AS INT) AS prio, {q6('key', 'key')} FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prio, key) AS rn "
            f"FROM ({lists}) l) z WHERE rn = 1")


@query("wn_06_ordered_union_distinct", sel(hard_sql("SELECT * FROM ev WHERE has_doc AND iou < 0.5"), EV))
def ordered_union_distinct(spark, sf):
    rows = ev(spark, sf)
    pos = rows.where("has_doc")
    return R.ordered_union_distinct([
        (pos.where("iou < 0.5"), F.col("iou")), (rows.where("NOT has_doc AND score >= 0.5"), -F.col("score")),
        (pos.where("score < 0.5"), F.col("score"))]).select("name", "prio", r6("key"))


@query("wn_07_rank_leaderboard", sel(
    f"SELECT model, dataset, {q6('mean_iou', 'mean_iou')}, {q6('recall_95', 'recall_95')}, {q6('recall_99', 'recall_99')}, {q6('p95', 'corner_error_p95_px')}, "
    f"CAST(rank() OVER (ORDER BY q, recall_95 DESC, recall_99 DESC, p95) AS INT) AS rank FROM (SELECT *, -round(mean_iou, 2) AS q FROM mm) m JOIN pp USING (model, dataset)",
    [*RUNS, ("pp", "SELECT model, dataset, quantile_cont(e, 0.95) AS p95 FROM (SELECT model, dataset, unnest([" + ", ".join(corner_err("a", "b")) + "]) AS e FROM mr) u GROUP BY model, dataset")]))
def rank_leaderboard(spark, sf):
    """Ranked by mean IoU to two decimals, so that the later keys decide between close models."""
    runs, rows = model_runs(spark, sf)
    errs = aggregate(rows, ["source", "split"], [F.count("*").alias("__n")], [percentile("corner_error_p95_px", 0.95, *[F.get("corner_errs", F.lit(i)) for i in range(4)])], inputs=["corner_errs"])
    runs = runs.join(errs.select(F.col("source").alias("model"), F.col("split").alias("dataset"), "corner_error_p95_px"), ["model", "dataset"])
    ranked = R.rank_leaderboard(runs.withColumns({"exact": F.col("mean_iou"), "mean_iou": F.round("mean_iou", 2)}))
    return rounded(ranked.withColumn("mean_iou", F.col("exact"))).select("model", "dataset", "mean_iou", "recall_95", "recall_99", "corner_error_p95_px", "rank")


TRAIN = ("e", "SELECT *, coalesce(max(mean_iou) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM train_history")


@query("wn_08_training_events", sel(
    f"SELECT epoch, {q6('best_value', 'best_value')}, CAST(improved AS INT) AS improved, best_epoch, epoch - best_epoch AS since_best, "
    "min(CASE WHEN epoch - best_epoch >= 4 THEN epoch END) OVER () AS stop_epoch FROM (SELECT epoch, mean_iou > prior AS improved, "
    "max(mean_iou) OVER (ORDER BY epoch) AS best_value, CAST(max(CASE WHEN mean_iou > prior THEN epoch ELSE 0 END) OVER (ORDER BY epoch) AS INT) AS best_epoch FROM e) z",
    [TRAIN]))
def training_events(spark, sf):
    rows = R.training_events(X.train_history(spark, sf).withColumn("run", F.lit("only")), 4, ["run"])
    return rows.select("epoch", r6("best_value"), num(F.col("improved")).alias("improved"), "best_epoch", "since_best", "stop_epoch")


def _lr_sql() -> str:
    # the counter as written: one up without a new best, back to zero at a best or a cut
    step = ("CASE WHEN h.mean_iou > l.best THEN 0 WHEN l.c + 1 >= 3 AND h.epoch > 5 THEN 0 ELSE l.c + 1 END")
    hit = "NOT h.mean_iou > l.best AND l.c + 1 >= 3 AND h.epoch > 5"
    return ("WITH RECURSIVE train_history AS (" + X.sql("train_history") + "), l AS (SELECT 0 AS epoch, 0e0 AS best, 0 AS c, false AS lr_cut UNION ALL "
            f"SELECT h.epoch, greatest(l.best, h.mean_iou), {step}, {hit} FROM l JOIN train_history h ON h.epoch = l.epoch + 1) "
            "SELECT epoch, CAST(lr_cut AS INT) AS lr_cut FROM l WHERE epoch > 0")


@query("wn_08_lr_events", _lr_sql())
def lr_events(spark, sf):
    return R.lr_events(X.train_history(spark, sf).withColumn("run", F.lit("only")), 3, 5, by=["run"]).select("epoch", num(F.col("lr_cut")).alias("lr_cut"))


@query("wn_09_candidate_order", sel(
    "SELECT name, CAST(row_number() OVER (ORDER BY round(iou, 6), detected, name) AS BIGINT) AS rn FROM (SELECT * FROM ev WHERE has_doc) z", EV))
def candidate_order(spark, sf):
    """Position of every row in the order (iou, undetected first, name)."""
    return R.global_running(positives(spark, sf).select("name", r6("iou"), "detected"), ["iou", "detected", "name"]).select("name", "rn")


MIN_ANGLE = f"least({', '.join(angle_sql('b'))})"


def queue_sql(where: str) -> str:
    return f"SELECT name, {q6('iou', 'iou')}, {q6('err_mean', 'err_mean')} FROM rv WHERE {where}"


LIVE = "NOT is_negative AND NOT discarded"


def queue(spark, sf, kind, sort):
    """Samples without a label count as having the zero label, so they are reviewed as negatives."""
    rows = reviewed(spark, sf).withColumn("is_negative", F.col("is_negative") | F.col("gt").isNull())
    return R.review_queue(rows, kind, sort).select("name", r6("iou"), r6("err_mean"))


RV = [*reviewed_ctes()]


@query("wn_10_review_queue_low", sel(queue_sql(f"has_gt AND {LIVE} AND iou >= 0.5 AND iou < 0.75"), RV))
def review_queue_low(spark, sf):
    return queue(spark, sf, "low_iou", "iou_asc")


@query("wn_10_review_queue_modified", sel(queue_sql("modified AND NOT discarded"), RV))
def review_queue_modified(spark, sf):
    return queue(spark, sf, "modified", "error_desc")


@query("wn_10_review_queue_high_error", sel(queue_sql(f"has_gt AND {LIVE} AND err_mean > 10"), RV))
def review_queue_high_error(spark, sf):
    return queue(spark, sf, "high_error", "error_desc")


@query("wn_10_review_queue_acute", sel(queue_sql(f"has_gt AND {LIVE} AND {MIN_ANGLE} < 60"), RV))
def review_queue_acute(spark, sf):
    return queue(spark, sf, "acute_gt", "gt_angle_asc")


KINDS = {"all": LIVE, "failed": f"{LIVE} AND iou < 0.5", "low_iou": f"{LIVE} AND iou >= 0.5 AND iou < 0.75", "medium_iou": f"{LIVE} AND iou >= 0.75 AND iou < 0.9",
         "high_iou": f"{LIVE} AND iou >= 0.9 AND iou < 0.95", "excellent": f"{LIVE} AND iou >= 0.95", "acute_gt": f"{LIVE} AND {MIN_ANGLE} < 60",
         "high_error": f"{LIVE} AND err_mean > 10", "modified": "modified AND NOT discarded", "discarded": "discarded", "negative": "is_negative AND NOT discarded",
         "train": "split = 'train'", "val": "split = 'val'"}
KIND_SORTS = {k: sort for k, sort in zip(KINDS, ["iou_asc", "error_desc", "error_asc", "iou_desc", "name", "gt_angle_asc", "gt_angle_desc", "iou_asc", "error_desc",
                                                 "error_asc", "iou_desc", "name", "iou_desc"])}


def _every_sql() -> str:
    order = {"iou_asc": "qi NULLS FIRST", "iou_desc": "qi DESC NULLS LAST", "error_asc": "qe NULLS FIRST", "error_desc": "qe DESC NULLS LAST",
             "gt_angle_asc": "qa NULLS FIRST", "gt_angle_desc": "qa DESC NULLS LAST", "name": "name"}
    src = (f"(SELECT rv.*, is_negative OR NOT has_gt AS neg, round(iou, 6) AS qi, round(err_mean, 6) AS qe, CASE WHEN has_gt THEN round({MIN_ANGLE}, 6) END AS qa FROM rv) z")
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, name, row_number() OVER (ORDER BY {order[KIND_SORTS[k]]}, name) AS place FROM {src} WHERE "
                              + where.replace("is_negative", "neg") for k, where in KINDS.items())


@query("wn_10_review_queue_every_filter", sel(_every_sql(), RV))
def review_queue_every_filter(spark, sf):
    """Place of each sample in the queue of every filter; the sorts take turns."""
    rows = reviewed(spark, sf).withColumn("is_negative", F.col("is_negative") | F.col("gt").isNull())
    return R.queue_places(rows, KIND_SORTS, digits=6)


@query("wn_11_limit_first", sel(
    "SELECT split, name FROM (SELECT split, name, row_number() OVER (PARTITION BY split ORDER BY sample_id) AS rn FROM quad_samples) z WHERE rn <= 50 "
    "UNION ALL SELECT 'all' AS split, name FROM (SELECT name FROM quad_samples ORDER BY sample_id LIMIT 50) y"))
def limit_first(spark, sf):
    s = X.samples(spark, sf)
    per = R.limit_first(s, 50, by=["split"]).select("split", "name")
    return per.unionByName(R.limit_first(s, 50).select(F.lit("all").alias("split"), "name"))
