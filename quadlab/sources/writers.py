"""Line formats and sinks. Every sink writes a directory of part files in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quadlab.functions import names as N
from quadlab.functions.geometry import fixed
from quadlab.sources.upsert import read_upserted, upsert
from quadlab.sources.versions import latest_version, read_version, write_version  # noqa: F401 - part of the sinks

EIGHT = " ".join(["%.6f"] * 8)


def _eight(coords: Column) -> list[Column]:
    # halves go to even before formatting
    return [F.bround(F.get(coords, F.lit(i)), 6) for i in range(8)]


def label_line(coords: Column, cls: int = 0) -> Column:
    """``class x0 ... y3`` with six decimals; an empty line text when there is no quad."""
    return F.when(coords.isNull(), F.lit("")).otherwise(F.format_string(f"{cls} {EIGHT}", *_eight(coords)))


def prediction_line(name: Column, detected: Column, conf: Column, coords: Column) -> Column:
    """Eleven tokens; eight -1 when undetected."""
    missing = F.array_repeat(F.lit(-1.0), 8)
    shown = F.when((detected == 1) & coords.isNotNull(), coords).otherwise(missing)
    numbers = [F.bround(conf, 6), *_eight(shown)]
    # decimals print the same digits as the formatter, which is slow, up to fifteen of them; it takes what is greater, null or no number
    short = F.greatest(*[F.coalesce(F.abs(v), F.lit(float("inf"))) for v in numbers]) < 1e9
    digits = [v.cast("decimal(16,6)").cast("string") for v in numbers]
    return F.when(short, F.concat_ws(" ", *[F.coalesce(v.cast("string"), F.lit("null")) for v in (name, detected)], *digits)).otherwise(
        F.format_string(f"%s %d %.6f {EIGHT}", name, detected, *numbers))


def write_split(df: DataFrame, path: str, order: str = "ord") -> None:
    """One text directory per split (``<path>/<split>.txt``), lines in order.

    Range partitioning keeps the order across part files, so no single task holds a split.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    # the partition column is final before the sort, so the writer has no reason to sort again
    (df.select(F.concat("split", F.lit(".txt")).alias("split"), order, "name")
     .repartitionByRange(n, "split", order).sortWithinPartitions("split", order).select("split", "name")
     .write.mode("overwrite").partitionBy("split").text(path))


def write_lines(df: DataFrame, line: Column, path: str, by: Column | None = None) -> None:
    if by is None:
        df.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        df.select(by.alias("part"), line.alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def write_labels(df: DataFrame, path: str, cls: int = 0) -> int:
    """Put labels (``stem``, ``coords``) into the label table at ``path``, in place of earlier ones of the same stems; the number of the write.

    Labels are rows (stem, line) of a keyed table, not one file each. Only the buckets with these stems are written anew and all take effect at once, so a write that fails leaves the old
    labels readable. Of rows that share a stem, the greatest line stays.
    """
    n = latest_version(df.sparkSession, path)
    lines = df.select("stem", label_line(F.col("coords"), cls).alias("line"), F.lit(n).cast("long").alias("written"))
    last = F.max(F.struct("written", "line")).alias("last")
    upsert(lines, path, "stem", lambda rows: rows.groupBy("stem").agg(last).select("stem", "last.line", "last.written"), n)
    return n


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """``stem, line`` of the label table."""
    return read_upserted(spark, path).select("stem", "line")


def write_predictions(df: DataFrame, path: str, order: str = "ord") -> None:
    """Text directories ``<path>/part=<split>_<source>`` of 11-token lines in the order of column ``order`` (by name without it).

    Rows are range-partitioned by file and order, so a file has few parts, in order, and any number of tasks writes it.
    """
    line = prediction_line(F.col("name"), F.col("detected"), F.col("conf"), F.col("coords"))
    n = df.sparkSession.sparkContext.defaultParallelism
    key = order if order in df.columns else "name"
    # lines are made after the shuffle: its sample of the keys reads all rows once more
    rows = df.select(F.concat_ws("_", "split", "source").alias("part"), F.col(key).alias("at"), "name", "detected", "conf", "coords")
    (rows.repartitionByRange(n, "part", "at").sortWithinPartitions("part", "at").select("part", line.alias("value"))
     .write.mode("overwrite").partitionBy("part").text(path))


EVAL_DECIMALS = {"iou": 6, "err_mean": 2, "err_max": 2, "score": 4}


def format_decimals(df: DataFrame, decimals: dict[str, int] = EVAL_DECIMALS) -> DataFrame:
    return df.withColumns({c: fixed(f"%.{d}f", F.col(c)) for c, d in decimals.items() if c in df.columns})


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] = EVAL_DECIMALS) -> None:
    format_decimals(df, decimals).write.mode("overwrite").csv(path, header=True)


def summary_json(counts: DataFrame, **params) -> DataFrame:
    """One JSON text from a one-row table of counts and the given parameters."""
    head = [F.lit(v).alias(k) for k, v in params.items()]
    body = F.struct(*[F.col(c) for c in counts.columns]).alias("counts")
    packed = F.struct(F.struct(*head).alias("params"), body) if head else F.struct(body)
    return counts.select(F.to_json(packed).alias("json"))


def write_summary(counts: DataFrame, path: str, **params) -> None:
    summary_json(counts, **params).write.mode("overwrite").text(path)


def worst_report_rows(evals: DataFrame, summary: DataFrame) -> DataFrame:
    """Header, rows, and a summary block per split: (part, key, line) to be ordered by part, error (greatest first) and name."""
    def fixed_lines(part: int, *lines: str) -> DataFrame:
        spark = evals.sparkSession
        return spark.createDataFrame([(part, (float(-i), ""), x) for i, x in enumerate(lines)], "part int, key struct<err_mean: double, name: string>, line string")
    rows = evals.select(
        F.lit(0).alias("part"), F.struct("err_mean", "name").alias("key"),
        fixed("%-8s %-60s %8.4f %10.2f %10.2f %8.4f", *[F.col(c) for c in (
            "split", "name", "iou", "err_mean", "err_max", "score")]).alias("line"))
    head = fixed_lines(-1, f"{'Split':<8} {'Filename':<60} {'IoU':>8} {'Err_mean':>10} {'Err_max':>10} {'Score':>8}", "=" * 110)
    title = fixed_lines(1, "", "=" * 110, "SUMMARY", "=" * 110)
    block = F.array(
        F.lit(""), F.format_string("%s (%d images):", F.upper("split"), "n"),
        fixed("  IoU:  mean=%.4f, min=%.4f, max=%.4f", *map(F.col, ("iou_mean", "iou_min", "iou_max"))),
        fixed("  Err:  mean=%.2fpx, min=%.2fpx, max=%.2fpx", *map(F.col, ("err_mean", "err_min", "err_max"))),
        F.format_string("  IoU < 0.9: %d images", "n_iou_lt_90"), F.format_string("  IoU < 0.8: %d images", "n_iou_lt_80"))
    # the blocks follow one another by split: one row per split, so its rank needs no distribution
    tail = (summary.withColumn("at", F.row_number().over(Window.orderBy("split"))).select("at", F.posexplode(block).alias("i", "line"))
            .select(F.lit(2).alias("part"), F.struct((-F.col("at") * 10 - F.col("i")).cast("double").alias("err_mean"), F.lit("").alias("name")).alias("key"), "line"))
    return head.unionByName(rows).unionByName(title).unionByName(tail)


def write_worst_report(evals: DataFrame, summary: DataFrame, path: str) -> None:
    """Greatest error first; range-partitioned sort, one text line per row."""
    rows = worst_report_rows(evals, summary)
    rows.orderBy("part", F.desc("key.err_mean"), "key.name").select("line").write.mode("overwrite").text(path)


def write_candidate_lists(df: DataFrame, path: str) -> None:
    """``<path>/all`` and ``<path>/split=<split>``, distinct names in order."""
    one = df.select("split", "name").distinct()
    one.select("name").distinct().orderBy("name").write.mode("overwrite").text(f"{path}/all")
    n = df.sparkSession.sparkContext.defaultParallelism
    (one.repartitionByRange(n, "split", "name").sortWithinPartitions("split", "name")
     .write.mode("overwrite").partitionBy("split").text(f"{path}/by_split"))


def review_index(samples: DataFrame, images: DataFrame, existing: DataFrame) -> DataFrame:
    """Index rows with a status: skipped_existing, missing_image, failed_open_image or written, the first that holds.

    ``images``: name and, where known, ``status`` (``failed_open_image`` of ``decode_images``); ``existing``: overlay_rel already rendered. Both are sets.
    """
    if "status" not in images.columns:
        images = images.withColumn("status", F.lit("ok"))
    overlay = F.concat("split", F.lit("/"), N.stem(F.col("name")), F.lit(".jpg"))
    have = images.select("name", F.coalesce("status", F.lit("ok")).alias("image"))
    done = existing.select("overlay_rel", F.lit(1).alias("has_overlay"))
    return (samples.select("split", "name", "is_negative", overlay.alias("overlay_rel"))
            .join(have, "name", "left").join(done, "overlay_rel", "left")
            .withColumn("status", F.when(F.col("has_overlay") == 1, "skipped_existing").when(F.col("image").isNull(), "missing_image")
                        .when(F.col("image") == "failed_open_image", F.col("image")).otherwise("written"))
            .drop("image", "has_overlay"))


def write_review_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").json(path)


def dataset_fingerprint(names: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free key of a name list: row count and two independent hash sums.

    Hash sums merge like any other sum, so no task ever holds the list.
    """
    def part(c: Column) -> Column:
        # 13 hex digits keep every summand below 2^52; decimal sums cannot overflow
        return F.conv(c, 16, 10).cast("decimal(20,0)")
    digest = F.md5("name")
    return names.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.sum(part(F.substring(digest, 1, 13))).cast("string").alias("h1"),
        F.sum(part(F.substring(digest, 14, 13))).cast("string").alias("h2"))

