"""SRC-*, SNK-*: readers and sinks. Files are written by Spark from the tables, then read back."""

from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.aggregates import EV, RUNS, model_runs, rounded
from quadlab.catalog.jobs import CV, decisions
from quadlab.catalog.joins import base, index
from quadlab.catalog.shared import cols, num, q6, r6, sel, spread
from quadlab.checkpoints import cut, scratch_dir
from quadlab.functions import names as N
from quadlab.operators import metrics as M, scoring
from quadlab.operators.ranking import places
from quadlab.plans import cleaning as K, consensus as V
from quadlab.sources import readers as R, results, writers as W
from quadlab.sources.versions import clean_versions, pinned_version, versions as versions_of

# ---------------------------------------------------------------- readers


@query("src_01_read_split", sel("SELECT split, name FROM quad_samples"))
def read_split(spark, sf):
    """Lines carry a directory prefix and blank lines follow them."""
    path = scratch_dir(spark)
    lines = X.samples(spark, sf).select("split", F.explode(F.array(
        F.concat(F.when(F.col("is_negative"), "images-negative/").otherwise("images/"), "name", F.lit("  ")), F.lit(""))).alias("line"))
    W.write_lines(lines, F.col("line"), path, F.concat("split", F.lit(".txt")))
    return R.read_split(spark, path).select("split", "name")


@query("src_02_resolve_split", sel("SELECT split, name FROM quad_samples WHERE split = 'train' OR sample_id % 2 = 0"))
def resolve_split(spark, sf):
    """The train list exists in two variants, the val list only in its plain one."""
    s = X.samples(spark, sf)
    plain = s.where("sample_id % 2 = 0").select("split", "name")
    more = s.where("split = 'train'").select(F.lit("train_with_negative").alias("split"), "name")
    return R.resolve_split(plain.unionByName(more)).select("split", "name")


def label_lines(spark, sf):
    """Label files with a blank first line, a leading class-1 line, a tenth token or a NaN, by sample number."""
    rows = X.labels(spark, sf).withColumn("r", F.col("sample_id") % 7)
    good = W.label_line(F.col("coords"))
    half = F.lit("1 " + " ".join(["0.5"] * 8))
    r = F.col("r")
    lines = (F.when(r == 0, F.array(F.lit(""), good)).when(r == 1, F.array(half, good))
             .when(r == 2, F.array(F.concat(good, F.lit(" 9")))).when(r == 3, F.array(F.regexp_replace(good, r"^0 \S+", "0 nan")))
             .otherwise(F.array(good)))
    return rows.select("stem", F.posexplode(lines).alias("ord", "line"))


def _label_sql() -> str:
    v = [f"CAST(printf('%.6f', g{i}) AS DOUBLE)" for i in range(8)]
    clip = [f"least(greatest({x}, 0), 1)" for x in v]
    turned = _sumdiff_sql(v)

    def row(mode: str, empty: str, half: str, values: list[str]) -> str:
        x = ", ".join(f"CASE WHEN r IN ({empty}) THEN NULL WHEN r IN ({half}) THEN 0.5e0 ELSE {c} END + 0e0 AS x{i}" for i, c in enumerate(values))
        return f"SELECT '{mode}' AS mode, name[:-5] AS stem, {x} FROM {src}"
    src = "(SELECT *, sample_id % 7 AS r FROM quad_samples WHERE g0 IS NOT NULL) s"
    parts = [row("strict", "1, 3", "-1", clip), row("lenient", "0, 3", "1", clip), row("exact", "2, 3", "1", turned), row("class0", "3", "-1", clip)]
    parts.append(row("multi", "-1", "-1", clip) + " WHERE r <> 3")
    parts.append(row("multi", "-1", "1", clip) + " WHERE r = 1")
    return " UNION ALL ".join(parts)


def _sumdiff_sql(v: list[str]) -> list[str]:
    """Corners by least x+y, least y-x, greatest x+y, greatest y-x; the first of equals."""
    s, d = ([f"({v[2 * i]} + {v[2 * i + 1]})" for i in range(4)], [f"({v[2 * i + 1]} - {v[2 * i]})" for i in range(4)])
    out = []
    for keys, end in ((s, "least"), (d, "least"), (s, "greatest"), (d, "greatest")):
        at = f"list_position([{', '.join(keys)}], {end}({', '.join(keys)}))"
        out += [f"[{', '.join(v[2 * i + k] for i in range(4))}][{at}]" for k in range(2)]
    return out


@query("src_03_read_labels", sel(_label_sql()))
def read_labels(spark, sf):
    """The five label modes over the same lines, which are stored as five passes read them."""
    lines = cut(label_lines(spark, sf))
    out = None
    for mode in ("strict", "lenient", "exact", "class0", "multi"):
        part = R.labels_from_lines(lines, mode).select(F.lit(mode).alias("mode"), "stem", *spread(F.col("coords"), "x"))
        out = part if out is None else out.unionByName(part)
    return out


def prediction_lines(spark, sf):
    """Prediction lines with an outdated first line (every 5th), a short line (every 7th) and a NaN line (every 11th)."""
    p = X.predictions(spark, sf)
    line = W.prediction_line(F.col("name"), F.col("detected"), F.col("conf"), F.col("coords"))
    k = F.col("sample_id")
    lines = F.array_compact(F.array(
        F.when(k % 5 == 0, F.concat("name", F.lit(" 1 0.5" + " 0.25" * 8))), line,
        F.when(k % 7 == 0, F.concat("name", F.lit(" 1 0.75" + " 0.5" * 7))),
        F.when(k % 11 == 0, F.concat("name", F.lit(" 1 0.75 nan" + " 0.5" * 7)))))
    return p.select("split", "source", F.posexplode(lines).alias("ord", "line"))


CONF6 = "CAST(printf('%.6f', conf) AS DOUBLE)"
XS = [f"CAST(printf('%.6f', c{i}) AS DOUBLE)" for i in range(8)]


def _each(expr: str) -> str:
    """An expression over X (the printed coordinate) for all eight, named x0 to x7."""
    return ", ".join(f"{expr.replace('X', x)} AS x{i}" for i, x in enumerate(XS))


NAN_FIRST = ", ".join(f"CASE WHEN sample_id % 11 = 0 THEN {'NULL' if i == 0 else '0.5e0'} WHEN sample_id % 7 = 0 THEN NULL WHEN detected = 1 THEN {x} END AS x{i}"
                      for i, x in enumerate(XS))


@query("src_04_prediction_rules", sel(
    f"SELECT 'strict' AS mode, source, name, detected, {CONF6} AS conf, {_each('CASE WHEN detected = 1 THEN X END')} FROM quad_predictions UNION ALL "
    f"SELECT 'keep', source, name, detected, {CONF6}, {_each('X')} FROM quad_predictions UNION ALL "
    f"SELECT 'detected_only', source, name, 1, CASE WHEN detected = 1 THEN {CONF6} ELSE 0.5e0 END, {_each('CASE WHEN detected = 1 THEN X ELSE 0.25e0 END')} "
    f"FROM quad_predictions WHERE detected = 1 OR sample_id % 5 = 0 UNION ALL "
    f"SELECT 'lenient', source, name, CASE WHEN sample_id % 77 = 0 OR sample_id % 11 = 0 OR sample_id % 7 = 0 THEN 1 ELSE detected END, "
    f"CASE WHEN sample_id % 11 = 0 OR sample_id % 7 = 0 THEN 0.75e0 ELSE {CONF6} END, {NAN_FIRST} FROM quad_predictions"))
def prediction_rules(spark, sf):
    # four passes read the lines
    lines = cut(prediction_lines(spark, sf))
    out = None
    for mode in ("strict", "keep", "detected_only", "lenient"):
        x = [F.nanvl(F.get("coords", F.lit(i)), F.lit(None).cast("double")).alias(f"x{i}") for i in range(8)]
        part = R.parse_predictions(lines, mode).select(F.lit(mode).alias("mode"), "source", "name", "detected", "conf", *x)
        out = part if out is None else out.unionByName(part)
    return out


@query("src_04_read_predictions", sel(
    f"SELECT split, source, name, detected, {CONF6} AS conf, {_each('CASE WHEN detected = 1 THEN X END')} FROM quad_predictions"))
def read_predictions(spark, sf):
    path = scratch_dir(spark)
    W.write_predictions(X.predictions(spark, sf), path)
    rows = R.read_predictions(spark, path)
    return rows.select("split", "source", "name", "detected", "conf", *spread(F.col("coords"), "x"))


@query("src_04_read_predictions_subset", sel("SELECT source, name, detected FROM quad_predictions WHERE sample_id % 17 = 0"))
def read_predictions_subset(spark, sf):
    path = scratch_dir(spark)
    W.write_predictions(X.predictions(spark, sf), path)
    return R.read_predictions(spark, path, wanted=X.outlier_names(spark, sf)).select("source", "name", "detected")


@query("src_05_read_eval_csv", sel(
    "SELECT split, name, round((sample_id % 1000) / 1000e0, 6) AS iou, (sample_id % 50) * 0.5e0 AS err_mean FROM quad_samples WHERE sample_id % 9 <> 0"))
def read_eval_csv(spark, sf):
    """Names sit in one of four columns; every ninth IoU is not a number; each row is preceded by an older one; files differ in columns and their order."""
    path = scratch_dir(spark)
    k = F.col("sample_id")
    alias = [F.when(k % 4 == i, F.col("name")).alias(c) for i, c in enumerate(R.NAME_ALIASES)]
    rows = X.samples(spark, sf).withColumn("old", F.explode(F.array(F.lit(True), F.lit(False))))
    iou = F.when(k % 9 == 0, "nan").when(F.col("old"), "0.5").otherwise(F.format_string("%.6f", (k % 1000) / 1000.0))
    # both rows of a name follow one another in one file
    rows = rows.withColumn("iou", iou).withColumn("err_mean", (k % 50) * 0.5)
    rows.where(k % 2 == 0).select("split", *alias, "iou", "err_mean").write.csv(path, header=True)
    rows.where(k % 2 == 1).select("err_mean", F.col("name").alias("file"), "iou", F.lit("x").alias("more"), "split").write.mode("append").csv(path, header=True)
    return R.read_eval_csv(spark, path).select("split", "name", r6("iou"), "err_mean")


@query("src_06_read_audit_csv", sel(
    "SELECT split, name, CAST(sample_id % 3 < 2 AS INT) AS detected, CASE WHEN sample_id % 5 = 0 THEN 0e0 ELSE 0.75e0 END AS conf, "
    "CASE WHEN sample_id % 4 <> 0 THEN 0.5e0 END AS iou, 640 + sample_id % 7 AS w FROM quad_samples").replace("640 + sample_id % 7", "CAST(640 + sample_id % 7 AS INT)"))
def read_audit_csv(spark, sf):
    path = scratch_dir(spark)
    k = F.col("sample_id")
    rows = X.samples(spark, sf).select(
        "sample_id", "split", F.col("name").alias("filename"), F.when(k % 3 == 0, "1").when(k % 3 == 1, "True").otherwise("0").alias("teacher_detected"),
        F.when(k % 5 != 0, "0.75").alias("teacher_conf"), F.when(k % 4 != 0, "0.5").alias("iou"), F.lit("").alias("err_mean_px"),
        F.lit("1.5").alias("err_max_px"), F.concat((k % 7 + 640).cast("string"), F.lit(".0")).alias("w"), F.lit("480").alias("h"))
    # two layouts of the same columns
    names = [c for c in rows.columns if c != "sample_id"]
    rows.where(k % 2 == 0).select(*names).write.csv(path, header=True)
    rows.where(k % 2 == 1).select(*reversed(names)).write.mode("append").csv(path, header=True)
    return R.read_audit_csv(spark, path).select("split", "name", num(F.col("detected")).alias("detected"), "conf", "iou", "w")


@query("src_07_read_review_index", sel(
    "SELECT split, name, CAST(starts_with(name, 'negative_') AS INT) AS negative FROM quad_samples WHERE sample_id % 6 NOT IN (1, 2, 3)"))
def read_review_index(spark, sf):
    """By sample number: broken JSON, a row with an error, a row without overlay."""
    path = scratch_dir(spark)
    k = F.col("sample_id") % 6
    row = F.struct("split", "name", F.when(k == 3, "").otherwise(F.concat("split", F.lit("/"), "name")).alias("overlay_rel"), "is_negative",
                   F.when(k == 2, "missing image").alias("error"))
    X.samples(spark, sf).select(F.when(k == 1, "{broken").otherwise(F.to_json(row)).alias("value")).write.text(path)
    return R.read_review_index(spark, path).select("split", "name", num(F.col("is_negative")).alias("negative"))


@query("src_08_read_nested_report", sel("SELECT name, CASE WHEN detected = 1 THEN 'OK' ELSE 'NO_DOCUMENT' END AS status, conf, " + cols("c") + " FROM quad_predictions WHERE source = 'teacher'"))
def read_nested_report(spark, sf):
    """Reports of at most 1000 consecutive samples each; earlier reports hold other entries of the same names."""
    path = scratch_dir(spark)
    p = X.predictions(spark, sf).where("source = 'teacher'")
    s = F.struct(F.col("name").alias("filename"), F.when(F.col("detected") == 1, "OK").otherwise("NO_DOCUMENT").alias("detector_status"),
                 F.col("conf").alias("detector_confidence"), F.col("coords").alias("pred_norm8"))
    old = s.withField("detector_status", F.lit("OLD"))
    # folders of earlier reports sort first
    part = F.floor(F.col("sample_id") / 1000).cast("string")
    both = p.select(F.concat(F.lit("new-"), part).alias("part"), s.alias("s")).unionByName(
        p.select(F.concat(F.lit("earlier-"), part).alias("part"), F.explode(F.array_repeat(old, 2)).alias("s")).where(F.col("s.filename") != ""))
    (both.groupBy("part").agg(F.collect_list("s").alias("samples"))
     .select("part", F.to_json(F.struct(F.struct(F.lit(0.97).alias("iou_threshold")).alias("params"), "samples")).alias("value"))
     .write.partitionBy("part").text(path))
    return R.read_nested_report(spark, path).select(
        F.col("filename").alias("name"), F.col("detector_status").alias("status"), F.col("detector_confidence").alias("conf"),
        *spread(F.col("pred_norm8"), "c"))


def evals(spark, sf):
    return K.full_evaluation(*base(spark, sf), "teacher")


@query("src_09_read_worst_report", sel(
    "SELECT split, name, CAST(printf('%.4f', iou) AS DOUBLE) AS iou, CAST(printf('%.2f', err_mean) AS DOUBLE) AS err_mean FROM ev WHERE has_doc", EV))
def read_worst_report(spark, sf):
    path = scratch_dir(spark)
    rows = evals(spark, sf)
    W.write_worst_report(rows, M.split_summary(rows), path)
    return R.read_worst_report(spark, path).select("split", "name", "iou", "err_mean")


@query("src_10_read_name_set", sel("SELECT name FROM quad_samples WHERE sample_id % 17 = 0"))
def read_name_set(spark, sf):
    path = scratch_dir(spark)
    names = X.outlier_names(spark, sf).select(F.explode(F.array("name", F.concat(F.lit("  "), "name"), F.lit(""))).alias("value"))
    names.write.text(path)
    return R.read_name_set(spark, path).unionByName(R.read_name_set(spark, path + "-missing"))


@query("src_11_list_files", sel("SELECT DISTINCT '.txt' AS ext, 'prefix=' || split_part(name, '_', 1) || '_' || split_part(name, '_', 2) AS dir FROM quad_samples WHERE NOT starts_with(name, 'negative_')"))
def list_files(spark, sf):
    """Folders and extensions of an export by name prefix."""
    path = scratch_dir(spark)
    X.samples(spark, sf).select("prefix", "name").where(~F.col("is_negative")).write.partitionBy("prefix").text(path)
    return R.list_files(spark, path, [".txt"]).select("ext", N.base_name(F.col("dir")).alias("dir")).distinct()


@query("src_12_read_metric_reports", sel(
    f"SELECT model, dataset, {q6('mean_iou', 'mean_iou')}, {q6('recall_95', 'recall_95')} FROM mm", RUNS))
def read_metric_reports(spark, sf):
    """One report per model: a JSON list of its few metric objects."""
    path = scratch_dir(spark)
    runs = model_runs(spark, sf)[0]
    (runs.groupBy("model").agg(F.to_json(F.collect_list(F.struct("model", "dataset", "mean_iou", "recall_95"))).alias("value"))
     .withColumn("part", F.col("model")).select("part", "value").write.partitionBy("part").text(path))
    return rounded(R.read_metric_reports(spark, path).select("model", "dataset", "mean_iou", "recall_95"))


@query("src_12_read_latency_report", sel(f"SELECT model, count(*) AS latency_ms_n, {q6('avg(ms)', 'latency_ms_mean')} FROM latency_runs GROUP BY model"))
def read_latency_report(spark, sf):
    path = scratch_dir(spark)
    s = M.latency_summary(X.latency_runs(spark, sf)).select(
        "model", F.col("mean_ms").alias("latency_ms_mean"), F.col("p50_ms").alias("latency_ms_p50"), F.col("p95_ms").alias("latency_ms_p95"), F.col("n").alias("latency_ms_n"))
    (s.withColumn("part", F.col("model")).groupBy("part").agg(F.collect_list(F.struct(*s.columns)).alias("results"))
     .select("part", F.to_json(F.struct(F.lit("val").alias("split"), F.lit("invoke").alias("mode"), F.lit(4).alias("threads"), "results")).alias("value"))
     .write.partitionBy("part").text(path))
    return rounded(R.read_latency_report(spark, path).select("model", "latency_ms_n", "latency_ms_mean"))


@query("src_13_read_training_history", sel(
    f"SELECT r || '/history' AS run, part, epoch, metric, value FROM (SELECT 'val' AS part, epoch, 'mean_iou' AS metric, {q6('mean_iou', 'value')} FROM train_history "
    f"UNION ALL SELECT 'train', epoch, 'loss', {q6('1 - mean_iou', 'value')} FROM train_history), (VALUES ('run=a'), ('run=b')) AS t(r)"))
def read_training_history(spark, sf):
    """Two runs with equal histories."""
    path = scratch_dir(spark)
    h = X.train_history(spark, sf)

    def series(name, value):
        ordered = F.sort_array(F.collect_list(F.struct("epoch", value.alias("v"))))
        return F.transform(ordered, lambda e: F.create_map(F.lit(name), e["v"]))
    (h.agg(series("loss", 1.0 - F.col("mean_iou")).alias("train"), series("mean_iou", F.col("mean_iou")).alias("val"))
     .select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run"), F.to_json(F.struct("train", "val")).alias("value")).write.partitionBy("run").text(path))
    out = R.read_training_history(spark, path)
    return rounded(out.withColumn("run", F.regexp_replace("run", "/part-.*", "/history")))


# ---------------------------------------------------------------- sinks


@query("snk_01_write_split", sel("SELECT split, name FROM quad_samples"))
def write_split(spark, sf):
    path = scratch_dir(spark)
    W.write_split(X.samples(spark, sf), path)
    return R.read_split(spark, path).select("split", "name")


LINE = "printf('{} %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', " + ", ".join(f"g{i}" for i in range(8)) + ")"


@query("snk_02_label_line", sel(
    f"SELECT name, CASE WHEN g0 IS NULL THEN '' ELSE {LINE.format(0)} END AS line0, CASE WHEN g0 IS NULL THEN '' ELSE {LINE.format(1)} END AS line1 FROM quad_samples"))
def label_line(spark, sf):
    rows = X.samples(spark, sf).join(X.labels(spark, sf).select("stem", "coords"), "stem", "left")
    return rows.select("name", W.label_line(F.col("coords")).alias("line0"), W.label_line(F.col("coords"), 1).alias("line1"))


@query("snk_02_write_labels", sel(
    f"SELECT name[:-5] AS stem, CASE WHEN sample_id % 7 = 1 THEN '' WHEN sample_id % 7 = 2 THEN {LINE.format(1)} ELSE {LINE.format(0)} END AS line FROM quad_samples WHERE g0 IS NOT NULL"))
def write_labels(spark, sf):
    """Labels of all samples, of which some are replaced by no label and others by a class-1 label."""
    path, lab = scratch_dir(spark), X.labels(spark, sf).select("stem", "coords", "sample_id")
    W.write_labels(lab, path)
    W.write_labels(lab.where("sample_id % 7 = 1").select("stem", F.lit(None).cast("array<double>").alias("coords")), path)
    W.write_labels(lab.where("sample_id % 7 = 2"), path, 1)
    return W.read_label_table(spark, path)


@query("snk_03_write_predictions", sel(
    "SELECT split, source, name, row_number() OVER (PARTITION BY split, source ORDER BY sample_id) AS place FROM quad_predictions"))
def write_predictions(spark, sf):
    """The place of each line in its file: the order of the split."""
    path = scratch_dir(spark)
    W.write_predictions(X.predictions(spark, sf).withColumnRenamed("sample_id", "ord"), path)
    rows = R.read_prediction_lines(spark, path).select("split", "source", "ord", F.split("line", " ")[0].alias("name"), F.concat_ws("_", "split", "source").alias("file"))
    return places(rows, "file", ["ord"]).select("split", "source", "name", "place")


@query("snk_03_prediction_line", sel(
    "SELECT printf('%s %d %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', name, detected, conf, " + ", ".join(f"c{i}" for i in range(8)) + ") AS line FROM quad_predictions"))
def prediction_line(spark, sf):
    p = X.predictions(spark, sf)
    return p.select(W.prediction_line(F.col("name"), F.col("detected"), F.col("conf"), F.col("coords")).alias("line"))


@query("snk_04_write_csv", sel("SELECT split, name, printf('%.6f', iou) AS iou, printf('%.2f', err_mean) AS err_mean, printf('%.2f', err_max) AS err_max, printf('%.4f', iou * 100 - err_mean) AS score FROM ev WHERE has_doc", EV))
def write_csv(spark, sf):
    path = scratch_dir(spark)
    W.write_csv(evals(spark, sf), path)
    return spark.read.csv(path, header=True)


@query("snk_05_write_summary", sel(
    "SELECT json_object('params', json_object('min_total', 1), 'counts', json_object('total', count(*), 'kept', count(*) FILTER (WHERE action <> 'drop'), "
    "'dropped', count(*) FILTER (WHERE action = 'drop'))) AS json FROM cv", CV))
def write_summary(spark, sf):
    path = scratch_dir(spark)
    W.write_summary(V.decision_counts(decisions(spark, sf)).select("total", "kept", "dropped"), path, min_total=1)
    return spark.read.text(path).select(F.col("value").alias("json"))


@query("snk_06_write_worst_report", sel(
    "SELECT printf('%-8s %-60s %8.4f %10.2f %10.2f %8.4f', split, name, iou, err_mean, err_max, iou * 100 - err_mean) AS line FROM ev WHERE has_doc UNION ALL "
    "SELECT printf('%-8s %-60s %8s %10s %10s %8s', 'Split', 'Filename', 'IoU', 'Err_mean', 'Err_max', 'Score') UNION ALL SELECT repeat('=', 110) FROM range(3) UNION ALL SELECT '' UNION ALL SELECT 'SUMMARY' "
    "UNION ALL SELECT unnest(['', upper(split) || ' (' || count(*) || ' images):', printf('  IoU:  mean=%.4f, min=%.4f, max=%.4f', avg(iou), min(iou), max(iou)), "
    "printf('  Err:  mean=%.2fpx, min=%.2fpx, max=%.2fpx', avg(err_mean), min(err_mean), max(err_mean)), '  IoU < 0.9: ' || count(*) FILTER (WHERE iou < 0.9) || ' images', "
    "'  IoU < 0.8: ' || count(*) FILTER (WHERE iou < 0.8) || ' images']) FROM ev WHERE has_doc GROUP BY split", EV))
def write_worst_report(spark, sf):
    """Every line of the report: header, rows, and a block per split."""
    path = scratch_dir(spark)
    rows = evals(spark, sf)
    W.write_worst_report(rows, M.split_summary(rows), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("snk_07_write_candidate_lists", sel(
    "SELECT 'all' AS list, name FROM ev WHERE has_doc AND iou < 0.9 UNION ALL SELECT split, name FROM ev WHERE has_doc AND iou < 0.9", EV))
def write_candidate_lists(spark, sf):
    path = scratch_dir(spark)
    W.write_candidate_lists(evals(spark, sf).where("iou < 0.9"), path)
    every = spark.read.text(f"{path}/all").select(F.lit("all").alias("list"), F.col("value").alias("name"))
    parts = R.read_split(spark, f"{path}/by_split").select(F.col("split").alias("list"), "name")
    return every.unionByName(parts)


@query("snk_08_review_index", sel(
    "SELECT s.split, s.name, s.split || '/' || s.name[:-5] || '.jpg' AS overlay_rel, CAST(starts_with(s.name, 'negative_') AS INT) AS negative, CASE WHEN s.sample_id % 13 <> 0 THEN 'skipped_existing' "
    "WHEN z.sample_id IS NULL THEN 'missing_image' WHEN s.sample_id % 5 = 0 THEN 'failed_open_image' ELSE 'written' END AS status FROM quad_samples s LEFT JOIN image_sizes z ON s.sample_id = z.sample_id"))
def review_index(spark, sf):
    path = scratch_dir(spark)
    done = index(spark, sf)[1].select(F.regexp_replace("overlay_rel", "png$", "jpg").alias("overlay_rel"))
    # every fifth image is empty, which the decoder refuses
    images = X.sizes(spark, sf)
    content = F.when(F.col("sample_id") % 5 == 0, F.lit("")).otherwise(F.col("name")).cast("binary")

    def decode(contents):
        if not all(contents):
            raise ValueError("broken image")
        return [[1.0]] * len(contents)
    images = scoring.decode_images(images.select("name", content.alias("content")), decode).select("name", "status")
    W.write_review_index(W.review_index(X.samples(spark, sf), images, done), path)
    out = spark.read.schema("split string, name string, overlay_rel string, is_negative boolean, status string").json(path)
    return out.select("split", "name", "overlay_rel", num(F.col("is_negative")).alias("negative"), "status")


@query("snk_09_versions", sel("SELECT 1 AS version, count(*) AS n FROM quad_samples UNION ALL SELECT 2, count(*) FILTER (WHERE sample_id % 17 <> 0) FROM quad_samples"))
def versions(spark, sf):
    """Two versions are written; a dry run in between leaves no trace."""
    path = scratch_dir(spark)
    s = X.samples(spark, sf).select("split", "name", "sample_id")
    W.write_version(s, path)
    W.write_version(s.limit(0), path, dry_run=True)
    W.write_version(s.where("sample_id % 17 <> 0"), path)
    out = [R_.agg(F.lit(v).alias("version"), F.count("*").alias("n")) for v, R_ in ((v, W.read_version(spark, path, v)) for v in (1, 2))]
    return out[0].unionByName(out[1])


@query("snk_09_retention", sel("SELECT 7 AS version, count(*) AS n, sum(sample_id)::BIGINT AS total, true AS is_open FROM quad_samples WHERE sample_id % 6 <> 0 UNION ALL "
                                "SELECT 1, count(*), sum(sample_id)::BIGINT, false FROM quad_samples WHERE sample_id % 7 <> 0"))
def retention(spark, sf):
    """Of seven versions the last two are kept; a reader that opened the first one still gets all of it after they are gone."""
    path, s = scratch_dir(spark), X.samples(spark, sf).select("sample_id")
    W.write_version(s.where("sample_id % 7 <> 0"), path)

    def row(df, version, is_open):
        return df.agg(F.lit(version).alias("version"), F.count("*").alias("n"), F.sum("sample_id").alias("total"), F.lit(is_open).alias("is_open"))
    with pinned_version(spark, path) as first:
        for k in range(6):
            W.write_version(s.where(F.col("sample_id") % 6 != (k + 1) % 6), path, keep=2)
        old = cut(row(first, 1, False))
    clean_versions(spark, path, 2)
    assert versions_of(spark, path) == [6, 7]
    return row(W.read_version(spark, path), 7, True).unionByName(old)


@query("snk_10_reused_result", sel("SELECT split, n, 1 + changed AS runs FROM (SELECT split, count(*) AS n FROM quad_samples GROUP BY split) a, (SELECT unnest([0, 1]) AS changed) b"))
def reused_result(spark, sf):
    """A result is computed once for the same names and parameters, wherever they are stored, and again when a name changes."""
    store, names = scratch_dir(spark), X.samples(spark, sf).select("split", "name")
    runs = []

    def count():
        runs.append(1)
        return names.groupBy("split").agg(F.count("*").alias("n"), F.lit(len(runs)).alias("runs"))
    for part in (4, 3):
        at = scratch_dir(spark)
        names.repartition(part).write.parquet(at)
        for _ in range(2):
            first = results.reused(spark.read.parquet(at), store, {"by": "split"}, count)
    changed = names.select(F.when(F.col("name") == "MIDV_a_10.jpg", "other.jpg").otherwise(F.col("name")).alias("name"))
    return first.unionByName(results.reused(changed, store, {"by": "split"}, count))


@query("snk_10_dataset_fingerprint", sel(
    "SELECT split, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(name), 1, 13)) AS BIGINT)) AS VARCHAR) AS h1, "
    "CAST(sum(CAST(('0x' || substr(md5(name), 14, 13)) AS BIGINT)) AS VARCHAR) AS h2 FROM quad_samples GROUP BY split"))
def dataset_fingerprint(spark, sf):
    return W.dataset_fingerprint(X.samples(spark, sf), ["split"])
