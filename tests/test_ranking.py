"""Cuts, global positions, percentiles and samples against plain Python on small, skewed tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlab.operators import metrics as M, ranking as R, sampling as S
from quadlab.operators.quantiles import aggregate, exact_percentiles, percentile


def skewed(n=3000, seed=1):
    """A third of the values are one and the same."""
    rng = random.Random(seed)
    return [(f"n{i:05d}", 0.5 if i % 3 == 0 else rng.betavariate(8, 1)) for i in range(n)]


def brute_drop(rows, target, cap):
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    n, total, gone, out = len(rows), sum(v for _, v in rows), 0.0, []
    while len(out) < n and (total - gone) / max(n - len(out), 1) < target:
        name, v = order[len(out)]
        gone += v
        out.append(name)
        if len(out) / n > cap:
            break
    return set(out)


@pytest.mark.parametrize("target,cap", [(0.8, 0.9), (0.85, 0.9), (0.9, 0.9), (0.99, 0.2), (0.1, 0.5), (2.0, 1.0), (0.9, 0.0)])
def test_drop_min_until_mean(spark, target, cap):
    rows = skewed()
    df = spark.createDataFrame(rows, "name string, iou double")
    out = R.drop_min_until_mean(df, target, cap)
    got = {r.name for r in out.where("dropped").collect()}
    assert got == brute_drop(rows, target, cap)
    assert out.count() == len(rows)


def test_drop_min_of_nothing(spark):
    df = spark.createDataFrame([], "name string, iou double")
    assert R.drop_min_until_mean(df, 0.9, 0.5).count() == 0


@pytest.mark.parametrize("frac,threshold", [(0.0, None), (0.1, None), (0.4, 0.97), (1.0, None)])
def test_drop_top_fraction(spark, frac, threshold):
    rows = skewed(seed=4)
    df = spark.createDataFrame(rows, "name string, err_mean double")
    got = {r.name for r in R.drop_top_fraction(df, frac, threshold=threshold).where("dropped").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = {n for n, _ in order[:int(frac * len(rows))]}
    if threshold is not None:
        want |= {n for n, v in rows if v > threshold}
    assert got == want


def test_global_running(spark):
    rows = skewed(seed=9)
    df = spark.createDataFrame(rows, "name string, iou double")
    got = R.global_running(df, ["iou", "name"], ["iou"]).orderBy("rn").collect()
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [r.name for r in got] == [n for n, _ in want]
    assert [r.rn for r in got] == list(range(1, len(rows) + 1))
    assert np.allclose([r.cum_iou for r in got], np.cumsum([v for _, v in want]))


@pytest.mark.parametrize("accuracy", [50, 400, 10000])
def test_exact_percentiles(spark, accuracy):
    rows = [("a" if i % 3 else "b", v) for i, (_, v) in enumerate(skewed(8000))] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in exact_percentiles(df, probs, "v", ["g"], accuracy).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-12)
    assert got["d"]["p50"] is None


def test_percentile_over_several_columns(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random() * 10, 3.0) for _ in range(4000)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = aggregate(df, [], [F.count("*").alias("n")], [percentile("q", 0.95, "x", "y", "z"), percentile("m", 0.5, "y")], 100).first()
    assert got.n == 4000
    assert got.q == pytest.approx(np.percentile(np.array(rows).ravel(), 95))
    assert got.m == pytest.approx(np.percentile([r[1] for r in rows], 50))


def test_weighted_sample(spark):
    df = spark.createDataFrame([(f"n{i:04d}", 5.0 if i % 10 == 0 else 1.0) for i in range(2000)], "name string, weight double")
    out = S.weighted_sample(df, "weight", 3, n=20000)
    assert out.count() == 20000
    heavy = out.where("weight = 5").count() / 20000
    assert heavy == pytest.approx(5 / 14, abs=0.02)
    again = S.weighted_sample(df, "weight", 3, n=20000)
    assert out.select("draw", "name").exceptAll(again.select("draw", "name")).count() == 0


def test_first_k_by_hash_is_exact(spark):
    df = spark.createDataFrame([("s" if i % 4 else "t", f"n{i}") for i in range(5000)], "split string, name string")
    targets = spark.createDataFrame([("s", 1234), ("t", 99999)], "split string, k long")
    out = S.first_k_by_hash(df, targets, ["split"], 5)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"s": 1234, "t": 1250}
    assert out.distinct().count() == 1234 + 1250


def test_paginate(spark):
    df = spark.range(1, 101).select(F.format_string("n%03d", "id").alias("name"))
    got = R.paginate(df, 24, 6, ["name"]).orderBy("name").collect()
    assert (got[0].page, got[0].grid_row, got[0].grid_col, got[0].n_pages) == (1, 0, 0, 5)
    assert (got[31].page, got[31].grid_row, got[31].grid_col) == (2, 1, 1)


def test_leaderboard_and_worst_case(spark):
    rows = [("a", "x", .9682), ("a", "y", .9047), ("b", "x", .9672), ("b", "y", .8997), ("c", "x", .9784), ("c", "y", .8321)]
    df = spark.createDataFrame(rows, "model string, dataset string, mean_iou double")
    got = {r.model: (r.worst_mean_iou, r["rank"]) for r in M.worst_case_across_datasets(df).collect()}
    assert got == {"a": (.9047, 1), "b": (.8997, 2), "c": (.8321, 3)}


def test_duplicates_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("h"), "id")
    got = M.duplicate_groups(df, "h", "id")
    assert got.count() == 1000 and got.where("group_size = 1000").count() == 1000
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_unit_report(spark):
    q = [.2, .2, .8, .2, .8, .8, .2, .8]
    rows = [(True, q, q, .9), (True, q, [v + .1 for v in q], .4), (False, None, q, .8)]
    df = spark.createDataFrame(rows, "has_doc boolean, gt array<double>, pred array<double>, score double")
    r = M.detection_metrics(M.evaluate_pairs(df)).first()
    assert r.num_samples == 3 and r.num_with_doc == 2
    assert r.mean_iou == pytest.approx((1 + .25 / .47) / 2)
    assert r.corner_error_max_px == pytest.approx(.1 * 2 ** .5 * 224)
    assert (r.cls_accuracy, r.cls_precision, r.cls_recall) == pytest.approx((1 / 3, .5, .5))


def test_report_without_positives(spark):
    df = spark.createDataFrame([(False, .1)], "has_doc boolean, score double")
    df = df.withColumns({"iou": F.lit(None).cast("double"), "err_mean": F.lit(None).cast("double"),
                         "corner_errs": F.lit(None).cast("array<double>")})
    r = M.detection_metrics(df).first()
    assert (r.mean_iou, r.median_iou, r.corner_error_p95_px, r.cls_f1, r.cls_accuracy) == (0, 0, 0, 0, 1)


@pytest.mark.parametrize("patience,warmup", [(2, 0), (3, 5), (4, 1)])
def test_lr_events(spark, patience, warmup):
    rng = random.Random(patience)
    values = [rng.random() for _ in range(40)]
    lr, best, count, want = 1.0, 0.0, 0, []
    for epoch, v in enumerate(values):
        if v > best:
            best, count = v, 0
            hit = False
        else:
            count += 1
            hit = epoch >= warmup and count >= patience and lr > 0.1
            if hit:
                lr, count = max(lr * 0.5, 0.1), 0
        want.append((epoch + 1, hit, lr))
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "run string, epoch int, mean_iou double")
    with pytest.raises(ValueError):
        R.training_events(df, 3, [])
    got = R.lr_events(df, patience, warmup, 1.0, 0.5, 0.1, by=["run"]).orderBy("epoch").collect()
    assert [(r.epoch, r.lr_cut, r.lr) for r in got] == [(e, h, pytest.approx(x)) for e, h, x in want]


def test_places_in_groups_of_any_share(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(9)]), i) for i in range(400)]
    got = R.places(spark.createDataFrame(rows, "g string, v int, id int"), "g", ["v", "id"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: i + 1 for i, r in enumerate(part)}
    assert {r.id: r.place for r in got} == want and len(got) == 400


def test_queue_places_follow_each_filters_sort(spark):
    rng = random.Random(9)
    rows = [(f"n{i:03}", rng.random() < 0.2, rng.random() < 0.2, rng.random() < 0.3, rng.choice(["train", "val"]), rng.choice([None, round(rng.random(), 2)]),
             rng.choice([None, rng.randrange(30) / 1.0]), rng.choice([None, rng.randrange(40, 90) / 1.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "name string, is_negative boolean, discarded boolean, modified boolean, split string, iou double, err_mean double, gt_min_angle double")
    sorts = {"all": "iou_asc", "low_iou": "name", "high_error": "error_desc", "acute_gt": "gt_angle_desc", "discarded": "iou_desc", "train": "error_asc"}
    got = sorted((r.kind, r.place, r.name) for r in R.queue_places(df, sorts).collect())
    want = [(k, i + 1, r.name) for k, s in sorts.items() for i, r in enumerate(R.review_queue(df, k, s).collect())]
    assert got == sorted(want)
