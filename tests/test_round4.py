"""Faults of the fourth round, each on a few rows."""

from pyspark.sql import functions as F

from quadlab.sources.readers import parse_predictions, read_prediction_lines
from quadlab.sources.writers import EIGHT, prediction_line


def test_lines_are_read_without_a_search_in_their_path(spark, tmp_path):
    """A pattern without a fixed start is tried at every place of the path, for every line."""
    for name in ("part=train_a_b.c/part-0.txt", "val_d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("p 1 0.5\r\n")
    df = read_prediction_lines(spark, str(tmp_path))
    assert sorted((r.split, r.source, r.line) for r in df.collect()) == [("train", "a_b", "p 1 0.5"), ("val", "d", "p 1 0.5")]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract(path" not in plan and "regexp_replace(value" not in plan


def test_predictions_are_parsed_without_functions_over_items(spark, tmp_path):
    """Spark interprets those for each item of each line."""
    eight = " 0.25 1.5" + " 0.5" * 6
    texts = ["a 1 0.5" + eight, "b 1 0.5 -0.1" + " 0.5" * 7, "c 1 0.5 nan" + " 0.5" * 7, "d 1.0 x" + eight, "e 1 0.5 0.5"]
    rows = [("val", "teacher", i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "split string, source string, ord int, line string").write.parquet(str(tmp_path / "t"))
    lines = spark.read.parquet(str(tmp_path / "t"))
    quad = [0.25, 1.5] + [0.5] * 6
    want = {"strict": {"a": (1, 0.5, [0.25, 1.0] + [0.5] * 6), "b": (0, 0.5, None)},
            "keep": {"a": (1, 0.5, quad), "b": (1, 0.5, [-0.1] + [0.5] * 7)},
            "detected_only": {"a": (1, 0.5, quad)}}
    for mode, rows in want.items():
        assert {r["name"]: (r.detected, r.conf, r.coords) for r in parse_predictions(lines, mode).collect()} == rows
    loose = {r["name"]: (r.detected, r.conf, r.coords) for r in parse_predictions(lines, "lenient").collect()}
    assert loose.keys() == set("abcde") and loose["d"] == (1, 0.0, quad) and loose["e"] == (1, 0.5, None)
    for mode in ("strict", "keep", "detected_only", "lenient"):
        assert "lambda" not in parse_predictions(lines, mode)._jdf.queryExecution().optimizedPlan().toString()


def test_prediction_lines_need_no_formatter(spark):
    """Decimals are the digits that the formatter prints; it is left to values that are great, missing or no numbers."""
    values = [0.5, 5e-7, 1.5e-6, -1e-7, -0.0, 1 / 3, 0.1234565, -0.1234575, 999999999.9999995, 1e9, 1e18, float("nan"), float("-inf"), None]
    rows = [("a", 1, v, [w] * 8) for v in values for w in values] + [(None, None, 0.5, [0.5] * 8), ("b", 0, 0.5, [0.5] * 8), ("c", 1, 0.5, None), ("d", 1, 0.5, [0.5] * 7)]
    df = spark.createDataFrame(rows, "name string, detected int, conf double, coords array<double>")
    shown = F.when((F.col("detected") == 1) & F.col("coords").isNotNull(), F.col("coords")).otherwise(F.array_repeat(F.lit(-1.0), 8))
    want = F.format_string(f"%s %d %.6f {EIGHT}", "name", "detected", F.bround("conf", 6), *[F.bround(F.get(shown, F.lit(i)), 6) for i in range(8)])
    out = df.select(prediction_line(*[F.col(c) for c in df.columns]).alias("line"), want.alias("want"))
    assert [r for r in out.collect() if r.line != r.want] == []
    assert "decimal(16,6)" in out._jdf.queryExecution().optimizedPlan().toString()
