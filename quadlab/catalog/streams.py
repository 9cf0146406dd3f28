"""STR-*, UDTF-1: streams replayed from stored tables to their end."""

from pyspark.sql import functions as F

from quadlab.catalog import query
from quadlab.catalog.aggregates import EV, ev, report_sql, rounded
from quadlab.catalog.files import label_lines
from quadlab.catalog.joins import STATE, events
from quadlab.catalog.shared import num, q6, r6, sel, spread
from quadlab.checkpoints import scratch_dir
from quadlab.operators.accumulator import RANK_ERROR, MetricAccumulator
from quadlab.sources import readers as R
from quadlab.sources.versions import read_version
from quadlab.streaming import running as S


def stream_of(df, files_per_batch=4):
    """Write a table and read it back as a stream, a few files per batch."""
    path = scratch_dir(df.sparkSession)
    df.repartition(8).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drained(writer):
    """Run a stream writer over all its input."""
    writer.trigger(availableNow=True).start().awaitTermination()


def ranked_report(report, rows, key="split"):
    """The report with, instead of its two quantiles, whether each is a value whose rank is within the stated error of the wanted one."""
    q = report.select(key, "median_iou", "corner_error_p95_px")
    # one row per group of the report
    both = rows.where("has_doc").join(F.broadcast(q), key)
    errs = F.array_compact(F.coalesce("corner_errs", F.array().cast("array<double>")))

    def near(below, upto, n, p):
        return ((below / n <= p + RANK_ERROR) & (upto / n >= p - RANK_ERROR)).cast("int")

    def inside(f):
        return F.size(F.filter(errs, f))
    m, e = F.col("median_iou"), F.col("corner_error_p95_px")
    ranks = both.groupBy(key).agg(
        near(F.count_if(F.col("iou") < m), F.count_if(F.col("iou") <= m), F.count("iou"), 0.5).alias("median_in_rank"),
        near(F.sum(inside(lambda x: x < e)), F.sum(inside(lambda x: x <= e)), F.sum(F.size(errs)), 0.95).alias("p95_in_rank"))
    return rounded(report.drop("median_iou", "corner_error_p95_px")).join(ranks, key)


RANKED = ("SELECT * EXCLUDE (median_iou, corner_error_p95_px), 1 AS median_in_rank, 1 AS p95_in_rank FROM (" + report_sql("split") + ")")
REPORT_COLUMNS = ["split", "has_doc", "score", "iou", "err_mean", "corner_errs"]


@query("str_01_running_metrics", sel(RANKED, EV))
def running_metrics(spark, sf):
    """The whole report after all batches; its median and p95 are checked by their ranks among all rows."""
    rows, path = ev(spark, sf).select(*REPORT_COLUMNS), scratch_dir(spark)
    drained(S.running_metrics(stream_of(rows), path, scratch_dir(spark)))
    return ranked_report(MetricAccumulator(spark, path, ["split"]).compute(), rows)


@query("udaf_01_metric_accumulator", sel(RANKED, EV))
def metric_accumulator(spark, sf):
    """Two halves counted apart, one of them with a batch that comes twice, and merged: the report of the whole."""
    rows = ev(spark, sf).select(*REPORT_COLUMNS, "name")
    half = F.pmod(F.xxhash64("name"), F.lit(2)) == 0
    a, b = (MetricAccumulator(spark, scratch_dir(spark), ["split"]) for _ in range(2))
    a.update(rows.limit(0), 0)
    a.reset()
    a.update(rows.where(half), 1)
    a.update(rows.where(half), 1)
    b.update(rows.where(~half))
    a.merge(b)
    return ranked_report(a.compute(), rows)


@query("str_02_running_worst", sel(f"SELECT name, {q6('iou', 'iou')} FROM ev WHERE has_doc ORDER BY iou, name LIMIT 100", EV))
def running_worst(spark, sf):
    path = scratch_dir(spark)
    rows = ev(spark, sf).where("has_doc").select("name", "iou")
    drained(S.running_worst(stream_of(rows), 100, path, scratch_dir(spark)))
    return read_version(spark, path).select("name", r6("iou"))


@query("str_03_running_review_state", sel(
    "SELECT CASE sample_id % 10 WHEN 0 THEN 'MIDV_a' WHEN 1 THEN 'smartdoc_ch1' WHEN 2 THEN 'id_card' WHEN 3 THEN 'id_detections' WHEN 4 THEN 'idcard_final' "
    "WHEN 5 THEN 'card_corner' WHEN 6 THEN 'receipt_jp' WHEN 7 THEN 'book_page' ELSE 'negative' END || '_' || sample_id || '.jpg' AS name, "
    "CAST(discarded AS INT) AS discarded, n_edits FROM st", STATE))
def running_review_state(spark, sf):
    path = scratch_dir(spark)
    drained(S.running_review_state(stream_of(events(spark, sf)), path, scratch_dir(spark)))
    return S.current_review_state(spark, path).select("name", num(F.col("discarded")).alias("discarded"), "n_edits")


@query("udtf_01_label_polygons", sel(
    "SELECT name[:-5] AS stem, 0 AS class, " + ", ".join(f"least(greatest(CAST(printf('%.6f', g{i}) AS DOUBLE), 0), 1) AS x{i}" for i in range(8))
    + " FROM quad_samples WHERE g0 IS NOT NULL AND sample_id % 7 <> 3 UNION ALL SELECT name[:-5], 1, " + ", ".join(["0.5e0"] * 8)
    + " FROM quad_samples WHERE g0 IS NOT NULL AND sample_id % 7 = 1"))
def label_polygons(spark, sf):
    """Every polygon of every label file, with all its points."""
    return R.labels_from_lines(label_lines(spark, sf), "multi").select("stem", "class", *spread(F.col("coords"), "x"))
