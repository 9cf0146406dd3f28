"""Readers. Text formats are read line by line (splittable); nothing is pulled into one row or task.

``ord`` is the struct (file name, file offset of the block, running line number). It sorts like the
lines of a file, or of part files in name order, and needs no global numbering.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadlab.checkpoints import cut
from quadlab.functions import names as N
from quadlab.functions.fence import computed
from quadlab.functions.geometry import clip01, is_finite_quad, order_tlbr_sumdiff
from quadlab.schema import SPLIT_VARIANTS

NAME_ALIASES = ["filename", "image", "name", "file"]


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """file (base name), ord, line."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (reader.text(path)
            .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
                    F.col("_metadata.file_block_start").alias("at"))
            .select("file", "path", F.struct("file", "at", F.monotonically_increasing_id().alias("seq")).alias("ord"),
                    F.rtrim("value", F.lit("\r")).alias("line")))


def _folder(path: Column) -> Column:
    """Name of the folder a file lies in. Each line has a path, and a pattern that is searched in one tries every place to start."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def _all(tests: Iterable[Column]) -> Column:
    return reduce(Column.__and__, tests)


def _tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _numbers(tokens: Column, start: int, n: int) -> Column:
    return F.transform(F.slice(tokens, start, n), lambda t: t.try_cast("double"))


# ---------------------------------------------------------------- split lists

def read_split(spark: SparkSession, path: str | Sequence[str], strip_prefix: bool = True) -> DataFrame:
    """split, ord, name. A split is a text file, or a directory of part files, named after the split."""
    lines = read_lines(spark, path, "[!._]*")
    parent = _folder(F.col("path"))
    split = F.when(F.col("file").startswith("part-"), F.regexp_replace(parent, r"^\w+=", "")).otherwise(
        N.stem(F.col("file")))
    split = F.regexp_replace(split, r"\.txt$", "")
    name = F.trim(F.col("line"))
    if strip_prefix:
        name = N.strip_image_dir(name)
    return lines.select(split.alias("split"), "ord", name.alias("name")).where(F.col("name") != "")


def variant_rank(variant: Column, base: Column, order: Sequence[str] = SPLIT_VARIANTS) -> Column:
    rank = None
    for i, suffix in enumerate(order):
        hit = variant == F.concat(base, F.lit(suffix))
        rank = F.when(hit, F.lit(i)) if rank is None else rank.when(hit, F.lit(i))
    return rank


def resolve_split(variants: DataFrame, order: Sequence[str] = SPLIT_VARIANTS) -> DataFrame:
    """Keep, per base split, the rows of its first existing variant.

    ``variants``: split (variant name), name, .... The list of variants is one row per split file
    name, so it is small whatever the number of samples; Spark decides how to join it back.
    """
    base = F.regexp_replace("split", r"_with_negative(_v2)?$", "")
    tagged = variants.withColumn("base", base)
    best = (tagged.groupBy("base", "split").agg(F.lit(1).alias("x"))
            .groupBy("base").agg(F.min_by("split", variant_rank(F.col("split"), F.col("base"), order)).alias("split")))
    return (tagged.join(best, ["base", "split"], "left_semi")
            .withColumn("split", F.col("base")).drop("base"))


# ---------------------------------------------------------------- labels

def parse_label_line(line: Column, mode: str = "strict", clip: bool = True) -> Column:
    """Eight coordinates of one label line, or null when the line is not valid in this mode."""
    t = _tokens(line)
    return _label_coords(t, _numbers(t, 2, 8), mode, clip)


def _label_coords(t: Column, coords: Column, mode: str, clip: bool) -> Column:
    cls = F.get(t, F.lit(0))
    enough = F.size(t) == 9 if mode == "exact" else F.size(t) >= 9
    ok = enough & is_finite_quad(coords)
    if mode in ("strict", "class0"):
        ok = ok & (cls == "0")
    out = F.when(ok, coords)
    if mode == "exact":
        return F.when(ok, order_tlbr_sumdiff(coords))
    return clip01(out) if clip else out


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """stem, ord, line: one row per label line."""
    return read_lines(spark, path, "*.txt").select(N.stem(F.col("file")).alias("stem"), "ord", "line")


def labels_from_lines(lines: DataFrame, mode: str = "strict", clip: bool = True) -> DataFrame:
    """stem, class, coords, n_lines from (stem, ord, line).

    strict, exact: the first non-blank line. lenient: the physical first line, any class.
    class0: the first line of class 0. multi: every parsable line, one row each.
    """
    # a line is split once and its numbers are read once, whatever refers to them
    lines = computed(lines.withColumn("blank", F.trim("line") == ""), {"t": _tokens(F.col("line"))}, ["stem", "ord", "blank"])
    lines = computed(lines, {"x": _numbers(F.col("t"), 2, 8)})
    parsed = computed(lines, {"class": F.get("t", F.lit(0)).try_cast("int"), "coords": _label_coords(F.col("t"), F.col("x"), mode, clip)},
                      ["stem", "ord", "blank"])
    if mode == "multi":
        return parsed.where(F.col("coords").isNotNull()).select("stem", "class", "coords", "ord")
    if mode == "lenient":
        key = F.col("ord")
    elif mode == "class0":
        key = F.when((F.col("class") == 0) & F.col("coords").isNotNull(), F.col("ord"))
    else:
        key = F.when(~F.col("blank"), F.col("ord"))
    first = F.min_by(F.struct("class", "coords"), key)
    return (parsed.groupBy("stem").agg(first.alias("f"), F.count_if(~F.col("blank")).alias("n_lines"))
            .select("stem", "f.class", "f.coords", "n_lines"))


def read_labels(spark: SparkSession, path: str, mode: str = "strict", clip: bool = True) -> DataFrame:
    return labels_from_lines(read_label_lines(spark, path), mode, clip)


# ---------------------------------------------------------------- predictions

def parse_predictions(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """Prediction rows from (split, source, ord, line); the last line of a name wins.

    strict: 11 tokens, finite numbers; undetected when the flag is not 1 or a coordinate is negative; clipped.
    keep: 11 tokens, finite numbers, coordinates as given. detected_only: detected rows with no negative coordinate.
    lenient: 3 tokens suffice, bad numbers become 0.
    """
    # a line is split once and its numbers are read once, whatever refers to them
    rows = computed(lines, {"t": _tokens(F.col("line"))}, ["split", "source", "ord"]).where(F.get("t", F.lit(0)) != "")
    # eight columns, as Spark interprets functions over the items of an array
    x = [F.col(f"__x{i}") for i in range(8)]
    flag, conf = F.get("t", F.lit(1)), F.get("t", F.lit(2)).try_cast("double")
    if mode == "lenient":
        rows, flag, conf = rows.where(F.size("t") >= 3), F.coalesce(flag.try_cast("double").try_cast("int"), F.lit(0)), F.coalesce(conf, F.lit(0.0))
    else:
        rows, flag = rows.where(F.size("t") == 11), flag.try_cast("int")
    rows = computed(rows, {"name": F.get("t", F.lit(0)), "detected": flag, "conf": conf} | {
        f"__x{i}": F.get("t", F.lit(i + 3)).try_cast("double") for i in range(8)}, ["split", "source", "ord"])
    coords = F.array(*x)
    if mode == "lenient":
        # fewer than eight numbers leave a null
        coords = F.when((F.col("detected") == 1) & _all(c.isNotNull() for c in x), coords)
    else:
        rows = rows.where(F.col("detected").isNotNull() & F.col("conf").isNotNull() & _all(F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in x))
        seen = (F.col("detected") == 1) & _all(~(c < 0) for c in x)
        if mode == "strict":
            coords = F.when(seen, F.array(*[F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in x]))
            rows = rows.withColumn("detected", seen.cast("int"))
        elif mode == "detected_only":
            rows = rows.where(seen)
    rows = rows.select("split", "source", "ord", "name", "detected", "conf", coords.alias("coords"))
    return last_wins(rows, ["split", "source", "name"])


def last_wins(rows: DataFrame, keys: Sequence[str], ord_col: str = "ord") -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != ord_col]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ord_col)).alias("r"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]))


def read_prediction_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``split, source, ord, line`` of files (or directories of part files) named ``<split>_<source>``."""
    lines = read_lines(spark, path, "[!._]*")
    parent = _folder(F.col("path"))
    key = N.stem(F.when(F.col("file").startswith("part-"), F.regexp_replace(parent, r"^\w+=", "")).otherwise(F.col("file")))
    return lines.select(F.substring_index(key, "_", 1).alias("split"),
                        F.regexp_extract(key, r"^[^_]+_(.*)$", 1).alias("source"), "ord", "line")


def read_predictions(spark: SparkSession, path: str | Sequence[str], mode: str = "strict",
                     wanted: DataFrame | None = None) -> DataFrame:
    """Prediction rows of those files; ``wanted`` keeps only its names."""
    rows = read_prediction_lines(spark, path)
    if wanted is not None:
        first = F.regexp_extract("line", r"^\s*(\S+)", 1)
        rows = rows.withColumn("name", first).join(wanted.select("name"), "name", "left_semi").drop("name")
    return parse_predictions(rows, mode)


# ---------------------------------------------------------------- CSV and JSON tables

def eval_rows(raw: DataFrame) -> DataFrame:
    """Evaluation rows from string columns; the name comes from the first filled alias column."""
    aliases = [F.when(F.trim(c) != "", F.trim(c)) for c in NAME_ALIASES if c in raw.columns]
    num = {c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
           for c in ("iou", "err_mean", "err_max", "score")}
    rows = raw.select(F.trim("split").alias("split"), F.coalesce(*aliases).alias("name"), "ord",
                      *[v.alias(k) for k, v in num.items()])
    finite = F.abs("iou") < float("inf")
    rows = rows.where((F.col("split") != "") & F.col("name").isNotNull() & finite)
    return last_wins(rows, ["split", "name"])


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` as string columns, each read by its own header line; a column that a file lacks is null.

    Records are lines. The headers come first (one per file, few distinct ones); then all lines are parsed in one pass.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"))
    lines = lines.withColumn("value", F.regexp_replace("value", r"^\uFEFF|\r$", "")).where(F.trim("value") != "")
    heads = cut(lines.where("at = 0").groupBy("file").agg(F.min_by("value", "seq").alias("head")))
    known = [r["head"] for r in heads.select("head").distinct().collect()]
    cells = {h: [c.strip() for c in next(csv.reader([h]))] for h in known}
    width = max(map(len, cells.values()), default=1)
    ddl = ", ".join(f"c{i} string" for i in range(width))
    # one row a file, as the file list itself; a shuffle by file would bring a large file into one task
    rows = lines.join(F.broadcast(heads), "file").where("value != head").withColumn("r", F.from_csv("value", ddl))
    place = F.struct("file", "at", "seq").alias("ord")

    def column(name: str) -> Column:
        out = F.lit(None).cast("string")
        for h, names in cells.items():
            if name in names:
                out = F.when(F.col("head") == h, F.col(f"r.c{names.index(name)}")).otherwise(out)
        return out.alias(name)
    return rows.select(*[column(c) for c in dict.fromkeys(c for names in cells.values() for c in names if c)], place)


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    return eval_rows(_csv(spark, path))


def audit_rows(raw: DataFrame) -> DataFrame:
    def blank(c: str) -> Column:
        return F.when(F.trim(c) != "", F.trim(c))
    rows = raw.select(
        F.trim("split").alias("split"), F.trim("filename").alias("name"), "ord",
        F.coalesce(blank("teacher_detected").isin("1", "True", "true"), F.lit(False)).alias("detected"),
        F.coalesce(blank("teacher_conf").try_cast("double"), F.lit(0.0)).alias("conf"),
        *[blank(c).try_cast("double").alias(c) for c in ("iou", "err_mean_px", "err_max_px")],
        *[blank(c).try_cast("double").try_cast("int").alias(c) for c in ("w", "h")])
    return last_wins(rows.where((F.col("split") != "") & (F.col("name") != "")), ["split", "name"])


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    return audit_rows(_csv(spark, path))


def read_review_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; bad lines and rows with an error are dropped."""
    raw = spark.read.text(path).select(F.col("value").alias("line"))
    ddl = "split string, name string, overlay_rel string, is_negative boolean, error string"
    rows = raw.select(F.from_json("line", ddl, {"mode": "PERMISSIVE"}).alias("r"),
                      F.get_json_object("line", "$.error").isNotNull().alias("failed"))
    return (rows.where(~F.col("failed") & F.col("r").isNotNull())
            .select(F.trim("r.split").alias("split"), F.trim("r.name").alias("name"),
                    F.trim("r.overlay_rel").alias("overlay_rel"),
                    F.coalesce("r.is_negative", F.lit(False)).alias("is_negative"))
            .where(F.col("split").isin("train", "val") & (F.col("name") != "") & (F.col("overlay_rel") != "")))


REPORT_DDL = ("samples array<struct<filename string, detector_status string, detector_confidence double, "
              "iou double, pred_norm8 array<double>, gt_norm8 array<double>, w int, h int>>")


def read_nested_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample of nested reports; the last entry of a file name wins, files in path order."""
    raw = spark.read.schema(REPORT_DDL).json(path, multiLine=True).select("samples", F.col("_metadata.file_path").alias("file"))
    rows = (raw.select("file", F.posexplode("samples").alias("pos", "s")).select(F.struct("file", "pos").alias("ord"), "s.*")
            .where(F.coalesce(F.col("filename"), F.lit("")) != ""))
    return last_wins(rows, ["filename"])


def read_worst_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a fixed-width report; rulers, the header and summary lines are skipped."""
    line = F.trim("value")
    rows = (spark.read.text(path).select(line.alias("line"))
            .where((F.col("line") != "") & ~F.col("line").rlike("^(=|Split|SUMMARY)"))
            .select(_tokens(F.col("line")).alias("t")).where(F.size("t") >= 5))
    num = [F.get("t", F.lit(i)).try_cast("double") for i in (2, 3, 4)]
    score = F.when(F.size("t") > 5, F.get("t", F.lit(5)).try_cast("double")).otherwise(F.lit(1.0))
    return (rows.select(F.get("t", F.lit(0)).alias("split"), F.get("t", F.lit(1)).alias("name"),
                        num[0].alias("iou"), num[1].alias("err_mean"), num[2].alias("err_max"), score.alias("score"))
            .dropna(subset=["iou", "err_mean", "err_max", "score"]))


def read_name_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed names; a missing file is an empty set, any other failure is raised."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string")
    return name_set(raw.select(F.col("value").alias("name")))


def name_set(names: DataFrame) -> DataFrame:
    return names.select(F.trim("name").alias("name")).where(F.col("name") != "").distinct()


def list_files(spark: SparkSession, path: str, exts: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """stem, ext, dir of the files below ``path``. File contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"{prefix}*").load(path).select("path"))
    name = N.base_name(F.col("path"))
    out = files.select(N.stem(name).alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"),
                       F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"))
    return out.where(F.col("ext").isin(list(exts))) if exts else out


def read_metric_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports written as a JSON list of metric objects."""
    return spark.read.json(path, multiLine=True)


LATENCY_DDL = ("split string, mode string, threads int, num_samples bigint, results array<struct<model string, "
               "latency_ms_mean double, latency_ms_p50 double, latency_ms_p95 double, latency_ms_n bigint>>")


def read_latency_report(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(LATENCY_DDL).json(path, multiLine=True)
    return raw.select("split", "mode", "threads", F.explode("results").alias("r")).select(
        "split", "mode", "threads", "r.*")


def read_training_history(spark: SparkSession, path: str) -> DataFrame:
    """run (the file's folder and stem), epoch (from 1), part (train or val), metric, value; metric keys may differ between files."""
    folder = F.regexp_extract("_metadata.file_path", r"([^/]*)/[^/]*$", 1)
    raw = spark.read.text(path, wholetext=True).select(
        F.concat_ws("/", folder, N.stem(F.col("_metadata.file_name"))).alias("run"), F.from_json("value", "train array<map<string,double>>, val array<map<string,double>>").alias("h"))
    parts = [raw.select("run", F.lit(p).alias("part"), F.posexplode(f"h.{p}").alias("i", "m"))
             .select("run", "part", (F.col("i") + 1).alias("epoch"), F.explode("m").alias("metric", "value"))
             for p in ("train", "val")]
    return parts[0].unionByName(parts[1])
