"""Versions, keyed tables, kept results and the stored report: replays, failures, readers, and equality with the work done at once."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quadlab.operators import accumulator as A, joins as J, metrics as M, scoring
from quadlab.sources import results, versions as V, writers as W
from quadlab.sources.upsert import read_upserted, upsert
from quadlab.streaming import running as S


def data_folders(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("data-"))


def test_retention_spares_open_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    V.write_version(spark.range(7), path, keep=3)
    with V.pinned_version(spark, path) as old:
        for i in range(50):
            V.write_version(spark.range(i).coalesce(1), path, keep=3)
        assert V.versions(spark, path) == [49, 50, 51] and old.count() == 7
        assert len(data_folders(tmp_path / "t")) == 4
    V.write_version(spark.range(1), path, keep=3)
    assert len(data_folders(tmp_path / "t")) == 3 and V.read_version(spark, path).count() == 1
    with pytest.raises(FileNotFoundError):
        with V.pinned_version(spark, path, 1):
            pass


def test_unfinished_folders_go_when_they_are_old(spark, tmp_path):
    path = str(tmp_path / "t")
    V.write_version(spark.range(2), path)
    spark.range(5).write.parquet(f"{path}/data-dead")
    assert V.clean_versions(spark, path, 1) == []
    time.sleep(1.1)
    V.Folder(spark, path).create("pin-1-left-behind")
    time.sleep(1.1)
    assert V.clean_versions(spark, path, 1, stale_s=1) == ["data-dead"]
    assert V.Folder(spark, path).names("pin-") == {} and V.read_version(spark, path).count() == 2


EVENTS = "seq long, name string, action string, coords array<double>"


def random_events(rng, n, names):
    kinds = ["discard", "undiscard", "modify", None]
    return [(i, rng.choice(names), rng.choice(kinds), [float(i)] * 2 if rng.random() < 0.9 else None) for i in range(n)]


def test_folds_of_batches_equal_one_fold(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "t")
    rows = random_events(rng, 400, [f"n{i}" for i in range(30)] + [None])
    rng.shuffle(rows)
    for b in range(8):
        upsert(J.review_rows(spark.createDataFrame(rows[b * 50:(b + 1) * 50], EVENTS)), path, "name", J.folded, b, 16)
    key = lambda r: (str(r.name), r)
    got = sorted((tuple(r) for r in S.current_review_state(spark, path).collect()), key=str)
    assert got == sorted((tuple(r) for r in J.fold_events(spark.createDataFrame(rows, EVENTS)).collect()), key=str) and len(got) == 31


def test_a_batch_rewrites_its_buckets_only_and_a_replay_nothing(spark, tmp_path):
    path = tmp_path / "t"
    first = spark.range(2000).select(F.col("id").cast("string").alias("name"), F.lit(1).alias("n"))

    def add(rows):
        return rows.groupBy("name").agg(F.sum("n").cast("int").alias("n"))

    assert upsert(first, str(path), "name", add, 0, 64) == 64
    before = V.pointer(spark, str(path))
    ten = first.limit(10)
    assert 1 <= upsert(ten, str(path), "name", add, 1, 64) <= 10
    newest = data_folders(path)
    written = [p for f in newest if f not in before for p in (path / f).glob("__bucket=*/*.parquet")]
    assert 1 <= len(written) <= 10
    names = V.versions(spark, str(path))
    assert upsert(ten, str(path), "name", add, 1, 64) == 0 and upsert(ten, str(path), "name", add, 0, 64) == 0
    assert V.versions(spark, str(path)) == names
    got = read_upserted(spark, str(path)).agg(F.count("*"), F.sum("n")).first()
    assert tuple(got) == (2000, 2010)
    assert upsert(first.limit(0), str(path), "name", add, 2, 64) == 0 and read_upserted(spark, str(path)).count() == 2000
    with pytest.raises(FileNotFoundError):
        read_upserted(spark, str(tmp_path / "none"))


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1)], "name string, n int")
    upsert(rows, path, "name", lambda r: r.groupBy("name").agg(F.sum("n").cast("int").alias("n")), 0)
    with pytest.raises(Exception):
        upsert(rows, path, "name", lambda r: r.withColumn("n", F.raise_error(F.lit("broken"))), 1)
    assert [tuple(r) for r in read_upserted(spark, path).collect()] == [("a", 1)]


def test_results_are_reused_until_a_name_changes(spark, tmp_path):
    store, src = str(tmp_path / "store"), str(tmp_path / "names")
    calls = []

    def work(names):
        def run():
            calls.append(1)
            return names.select("name", F.length("name").alias("n"))
        return run

    spark.createDataFrame([(f"a{i}",) for i in range(20)], "name string").write.parquet(src)
    names = spark.read.parquet(src)
    first = results.reused(names, store, {"k": 1}, work(names), True)
    names = spark.read.parquet(src)
    spark.sparkContext.setJobGroup("second call", "second call")
    again = results.reused(names, store, {"k": 1}, work(names), True)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("second call")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading the schema of the stored result is all that may run
    assert len(calls) == 1 and len(jobs) <= 1
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    results.reused(names, store, {"k": 2}, work(names))
    assert len(calls) == 2
    # the same names in other files and another order are the same names
    moved = str(tmp_path / "moved")
    names.orderBy(F.desc("name")).repartition(3).write.parquet(moved)
    results.reused(spark.read.parquet(moved), store, {"k": 1}, work(names))
    assert len(calls) == 2
    changed = str(tmp_path / "changed")
    names.select(F.when(F.col("name") == "a7", "b7").otherwise(F.col("name")).alias("name")).write.parquet(changed)
    results.reused(spark.read.parquet(changed), store, {"k": 1}, work(spark.read.parquet(changed)))
    assert len(calls) == 3


ROWS = "split string, has_doc boolean, score double, iou double, err_mean double, corner_errs array<double>"


def evaluated(rng, n):
    out = []
    for _ in range(n):
        doc = rng.random() < 0.8
        e = [rng.random() * 40 for _ in range(4)]
        out.append((rng.choice(["train", "val"]), doc, rng.random(), rng.random() if doc else None, sum(e) / 4 if doc else None, e if doc else None))
    return out


def test_states_merge_to_the_report_of_all_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = evaluated(rng, 6000) + [("odd", True, None, None, None, None), ("odd", False, 0.7, None, None, None), (None, True, 0.9, 0.5, 2.0, [1.0, 2.0, 3.0, None])]
    df = spark.createDataFrame(rows, ROWS)
    acc = [A.MetricAccumulator(spark, str(tmp_path / x), ["split"], keep=2) for x in "ab"]
    with pytest.raises(FileNotFoundError):
        acc[0].compute()
    for b in range(5):
        acc[b % 2].update(spark.createDataFrame(rows[b::5], ROWS), b)
    acc[0].update(df, 4)  # a replay
    acc[0].merge(acc[1])
    got = {r.split: r.asDict() for r in acc[0].compute().collect()}
    want = {r.split: r.asDict() for r in M.detection_metrics(df, ["split"]).collect()}
    assert got.keys() == want.keys() and set(got["train"]) == set(want["train"])
    values = {s: (sorted(r[3] for r in rows if r[0] == s and r[1] and r[3] is not None), sorted(x for r in rows if r[0] == s and r[1] and r[5] for x in r[5] if x is not None)) for s in got}
    for s in got:
        for c, v in want[s].items():
            if c in ("median_iou", "corner_error_p95_px"):
                vals, p = (values[s][0], 0.5) if c == "median_iou" else (values[s][1], 0.95)
                if not vals:
                    assert got[s][c] == v == 0
                    continue
                assert got[s][c] in vals
                low, high = sum(x < got[s][c] for x in vals) / len(vals), sum(x <= got[s][c] for x in vals) / len(vals)
                assert low - A.RANK_ERROR <= p <= high + A.RANK_ERROR
            else:
                assert got[s][c] == pytest.approx(v, abs=1e-9), (s, c)
    acc[0].reset()
    assert acc[0].compute().count() == 0
    acc[0].update(df)
    assert acc[0].compute().count() == len(want)


def test_an_accepted_prediction_is_what_was_shown_then(spark):
    preds = [("a", 1, 5, [0.1]), ("a", 2, 20, [0.2]), ("a", 3, 20, [0.3]), ("a", 4, 40, [0.4]), ("b", 1, 50, [0.5]), ("c", 1, 1, None), ("d", 1, 1, [0.7])]
    events = [(10, "a", "accept", None), (30, "a", "accept", None), (35, "b", "accept", None), (9, "c", "accept", None),
              (2, "d", "accept", None), (3, "d", "modify", [9.0]), (60, "e", "discard", None), (61, "b", "discard", None), (7, "f", "accept", None)]
    out = J.fold_events(J.accepted_predictions(spark.createDataFrame(events, EVENTS), spark.createDataFrame(preds, "name string, version int, seq long, coords array<double>")))
    got = {r.name: (r.discarded, r.edited, r.n_edits) for r in out.collect()}
    assert got == {"a": (False, [0.3], 2), "d": (False, [9.0], 2), "e": (True, None, 0), "b": (True, None, 0)}


def test_a_predictor_is_built_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def factory():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def predict(batch):
            batch["pid"] = os.getpid()
            return batch
        return predict

    def other():
        return lambda batch: batch.assign(pid=-1)

    rows = spark.range(0, 640, 1, 64)
    got = scoring.score(rows, factory, "id long, pid long").collect()
    loads = open(log).read().split()
    assert len(got) == 640 and len(loads) == len(set(loads)) and {str(r.pid) for r in got} <= set(loads)
    assert {r.pid for r in scoring.score(rows, other, "id long, pid long").collect()} == {-1}
    scoring.score(rows, factory, "id long, pid long").collect()
    again = open(log).read().split()
    assert len(again) == len(set(again))


def test_broken_images_are_rows_and_batches_are_bounded(spark):
    def decode(contents):
        assert len(contents) == 1 or sum(map(len, contents)) <= 100
        if any(c.startswith(b"!") for c in contents):
            raise OSError("broken")
        return [[float(len(c)), 1.0] for c in contents]

    rows = [(i, (b"!" if i % 7 == 0 else b"x") * (1 + i % 60), "z") for i in range(200)] + [(200, None, "z"), (201, b"", "z"), (202, b"y" * 500, "z")]
    files = spark.createDataFrame(rows, "id int, content binary, pid string")
    got = {r.id: r for r in scoring.decode_images(files, decode, most_bytes=100).collect()}
    assert len(got) == 203 and got[201].grid == [0.0, 1.0] and got[202].grid == [500.0, 1.0]
    for i, c, _ in rows:
        bad = c is None or c.startswith(b"!")
        assert got[i].status == ("failed_open_image" if bad else "ok") and (got[i].grid is None) == bad and got[i].pid == "z"
    assert scoring.decode_images(files.limit(0), decode).count() == 0
    with pytest.raises(ValueError):
        scoring.decode_images(files.withColumnRenamed("pid", "status"), decode)


def test_labels_are_replaced_at_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "labels")
    quad = [0.125 * i for i in range(8)]
    W.write_labels(spark.createDataFrame([("a", quad), ("b", quad), ("c", None)], "stem string, coords array<double>"), path)
    before = sorted(map(tuple, W.read_label_table(spark, path).collect()))
    assert [s for s, _ in before] == ["a", "b", "c"] and before[2][1] == "" and before[0][1].startswith("0 0.000000 0.125000")
    broken = spark.createDataFrame([("a", quad)], "stem string, coords array<double>").withColumn("coords", F.when(F.col("stem") == "a", F.raise_error(F.lit("stopped"))).cast("array<double>"))
    with pytest.raises(Exception):
        W.write_labels(broken, path)
    assert sorted(map(tuple, W.read_label_table(spark, path).collect())) == before
    W.write_labels(spark.createDataFrame([("a", None), ("d", quad)], "stem string, coords array<double>"), path, 1)
    after = dict(map(tuple, W.read_label_table(spark, path).collect()))
    assert after["a"] == "" and after["b"] == before[1][1] and after["d"].startswith("1 ") and len(after) == 4
