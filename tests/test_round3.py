"""Faults of the third round, each on a few rows."""

import builtins
import dis
import re
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - loads the catalog
from quadlab.catalog import QUERIES
from quadlab.functions.geometry import fixed
from quadlab.functions.overlap import with_polygon_iou
from quadlab.operators import quantiles
from quadlab.operators.quantiles import aggregate, exact_percentiles, percentile
from quadlab.operators.ranking import queue_places
from quadlab.sources.readers import _csv, parse_predictions


def _names(code):
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from _names(c)
    yield from (i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL")


def test_every_global_name_is_defined():
    """A query that uses a name its module lacks fails only when it is run."""
    lost = []
    for module in [m for n, m in sys.modules.items() if n.startswith("quadlab")]:
        for fn in [f for f in vars(module).values() if isinstance(f, types.FunctionType) and f.__code__.co_filename == module.__file__]:
            lost += [(module.__name__, fn.__name__, n) for n in _names(fn.__code__) if not hasattr(module, n) and not hasattr(builtins, n)]
    assert not lost


def test_iou_at_a_threshold(spark):
    """A quad and its lower part: the IoU is exactly the bound, whatever the order of the sum."""
    rows, h = [], 0.625
    for i, share in enumerate((0.5, 0.75, 0.8, 0.9, 0.95)):
        for j in range(60):
            x, y, w = j / 1024, (7 * j % 50) / 1024, 0.4 + j / 512
            rows.append((share, [x, y, x + w, y, x + w, y + h, x, y + h], [x, y, x + w, y, x + w, y + h * share, x, y + h * share]))
    df = spark.createDataFrame(rows, "share double, a array<double>, b array<double>")
    out = with_polygon_iou(df, [("a", "b", "iou")])
    assert out.where(F.col("iou") != F.col("share")).count() == 0


def test_decimals_of_the_binary_value(spark):
    """Halves that only the shortest decimal shows are no halves."""
    values = [0.075, 0.125, 0.375, 1.005, 2.675, 0.0, 64.84375, -0.075, -0.125, 1e-9, 123456.785, 1e18, None]
    values += [i * 0.005 for i in range(400)] + [i / 8192 for i in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed("%.2f", F.col("v")).alias("t"), fixed("%.6f", F.col("v")).alias("u")).collect()
    assert [(r.t, r.u) for r in rows if r.v is not None] == [(f"{r.v:.2f}", f"{r.v:.6f}") for r in rows if r.v is not None]


def test_queue_filters_see_values_as_they_are(spark):
    """0.7499999 is 0.75 to six decimals, but below it."""
    row = ("a", 0.7499999, 1.0, 80.0, False, False, False, "train")
    df = spark.createDataFrame([row], "name string, iou double, err_mean double, gt_min_angle double, is_negative boolean, discarded boolean, modified boolean, split string")
    got = queue_places(df, {"low_iou": "iou_asc", "medium_iou": "iou_asc"}, digits=6).collect()
    assert [(r.kind, r.name, r.place) for r in got] == [("low_iou", "a", 1)]


def test_csv_lines_are_not_shuffled_by_file(spark, tmp_path):
    spark.range(100).write.csv(str(tmp_path / "t"), header=True)
    df = _csv(spark, str(tmp_path / "t"))
    assert df.count() == 100
    assert "Exchange hashpartitioning(file" not in df._jdf.queryExecution().toString().replace("#", " #").replace("hashpartitioning(file #", "hashpartitioning(file")


def test_prediction_lines_are_split_once(spark, tmp_path):
    spark.createDataFrame([("val", "teacher", 1, "a 1 0.5" + " 0.5" * 8)], "split string, source string, ord int, line string").write.parquet(str(tmp_path / "t"))
    df = parse_predictions(spark.read.parquet(str(tmp_path / "t")), "strict")
    assert [(r.name, r.detected, r.conf, r.coords) for r in df.collect()] == [("a", 1, 0.5, [0.5] * 8)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_percentiles_do_not_bring_a_group_into_one_task(spark):
    """Brackets go to the rows, even where Spark would shuffle both sides by the group."""
    df = spark.range(1000).selectExpr("0 AS g", "CAST(id * 37 % 1000 AS DOUBLE) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_percentiles(df, {"p50": 0.5, "p95": 0.95}, "v", ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2
        assert [(r.p50, round(r.p95, 6)) for r in out.collect()] == [(499.5, 949.05)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_percentiles_of_many_groups(spark, monkeypatch):
    """Beyond the number of groups that is broadcast, rows are dealt by salts; the values are the same."""
    df = spark.range(3000).selectExpr("id % 3 AS g", "CAST(id * 37 % 1000 AS DOUBLE) AS v", "IF(id % 5 = 0, NULL, CAST(id AS DOUBLE)) AS w")
    specs = [percentile("v10", 0.1, "v"), percentile("both", 0.9, "v", "w")]

    def run():
        return sorted(tuple(r) for r in aggregate(df, ["g"], [F.count("*").alias("n")], specs, 100).collect())
    want = run()
    monkeypatch.setattr(quantiles, "FEW_GROUPS", 0)
    assert run() == want


def test_iou_of_four_quads_makes_no_huge_method(spark, capsys):
    """The JVM interprets methods of more than 8000 bytes."""
    quads = ["a", "b", "c", "d"]
    row = [[0.1, 0.1, 0.9, 0.1, 0.9, 0.9, 0.1, 0.9 - i / 10] for i in range(4)]
    df = spark.createDataFrame([row], ", ".join(f"{q} array<double>" for q in quads))
    pairs = [(p, q, f"iou_{p}{q}") for i, p in enumerate(quads) for q in quads[i + 1:]]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for order in ("ccw", "raw"):
            with_polygon_iou(df, pairs, order=order).explain("codegen")
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
            assert sizes and max(map(int, sizes)) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_guarded_counts_decide_once(spark):
    """The guard reads the decisions twice; they are stored, not made twice."""
    df = QUERIES["ag_11_guarded_counts"](spark, "/root/testdata/sf0.001")
    assert "ATAN2" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_predictions_are_clipped_once(spark):
    """The clipped corners are a column, not repeated for each coordinate that is read."""
    df = QUERIES["job_18_new_candidates"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("transform(") < 20


@pytest.mark.parametrize("few", [10000, 0])
def test_only_rows_inside_a_bracket_are_exploded(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW_GROUPS", few)
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 2}", float(x), float(y) if i % 5 else None) for i, (x, y) in enumerate(zip(rng.random(3000).round(3), rng.random(3000) * 2))]
    specs = [quantiles.percentile("a", 0.05, "x"), quantiles.percentile("b", 0.95, "x", "y"), quantiles.percentile("c", 1.0, "y"), quantiles.percentile("d", 0.5, "y")]
    out = quantiles.aggregate(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], [F.count("*").alias("n")], specs, accuracy=200)
    for r in out.collect():
        x, y = (np.array([t[k] for t in rows if t[0] == r.g and t[k] is not None]) for k in (1, 2))
        want = np.percentile(x, 5), np.percentile(np.concatenate((x, y)), 95), y.max(), np.percentile(y, 50)
        assert r.n == 1500 and np.allclose([r.a, r.b, r.c, r.d], want, rtol=0, atol=1e-12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert bool(re.search(r"(Filter|Join Inner).*>= __b\d#\d+\.lo", plan)) == (few > 0)
