"""Readers over real files with the broken lines they must skip; writers read back."""

import json

from pyspark.sql import functions as F

from quadlab.sources import readers as R, writers as W

Q = "0.1 0.1 0.9 0.1 0.9 0.9 0.1 0.9"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_split_order_and_prefixes(spark, tmp_path):
    names = [f"n{i}.jpg" for i in range(500)]
    put(tmp_path / "train.txt", "images/" + "\n\nimages/".join(names) + "\r\nimages-negative/negative_x.jpg\n")
    got = R.read_split(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.name for r in got] == names + ["negative_x.jpg"]
    assert {r.split for r in got} == {"train"}
    raw = R.read_split(spark, str(tmp_path), strip_prefix=False).orderBy("ord").first()
    assert raw.name == "images/n0.jpg"


def test_split_round_trip_keeps_order(spark, tmp_path):
    rows = [("train" if i % 3 else "val", (i * 7919) % 1000, f"n{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "split string, ord int, name string")
    W.write_split(df, str(tmp_path / "s"))
    got = R.read_split(spark, str(tmp_path / "s")).orderBy("ord").collect()
    for split in ("train", "val"):
        assert [r.name for r in got if r.split == split] == [n for s, o, n in sorted(rows, key=lambda r: r[1]) if s == split]


def test_label_modes(spark, tmp_path):
    files = {"good": f"0 {Q}\n", "blank": f"\n0 {Q}\n", "one": f"1 {Q}\n0 {Q}\n", "short": "0 0.1 0.2\n", "nan": f"0 nan {Q[4:]}\n",
             "long": f"0 {Q} 7\n", "out": f"0 -0.5 {Q[4:]}\n", "empty": ""}
    for n, t in files.items():
        put(tmp_path / f"{n}.txt", t)

    def valid(mode):
        return {r.stem for r in R.read_labels(spark, str(tmp_path), mode).where("coords is not null").collect()}
    assert valid("strict") == {"good", "blank", "long", "out"}
    assert valid("lenient") == {"good", "one", "long", "out"}
    assert valid("exact") == {"good", "blank", "one", "out"}
    assert valid("class0") == {"good", "blank", "one", "long", "out"}
    assert R.read_labels(spark, str(tmp_path), "multi").where("stem = 'one'").count() == 2
    out = R.read_labels(spark, str(tmp_path)).where("stem = 'out'").first().coords
    assert out[0] == 0.0
    assert R.read_labels(spark, str(tmp_path), clip=False).where("stem = 'out'").first().coords[0] == -0.5


def test_prediction_modes(spark, tmp_path):
    neg = " ".join(["-1"] * 8)
    lines = [f"a 1 0.9 {Q}", f"b 0 0.1 {neg}", f"c 1 0.5 -0.1 {Q[4:]}", f"d 1 0.5 {Q} 3", "e 1 0.5 0.1", f"f 1 0.5 nan {Q[4:]}",
             f"a 1 0.7 {Q}", "g x y", f"h 2.0 0.5 {Q}"]
    put(tmp_path / "train_teacher.txt", "\n".join(lines) + "\n")
    got = {m: {r.name: r for r in R.read_predictions(spark, str(tmp_path), m).collect()} for m in ("strict", "keep", "detected_only", "lenient")}
    assert {n: r.detected for n, r in got["strict"].items()} == {"a": 1, "b": 0, "c": 0}
    assert got["strict"]["a"].conf == 0.7 and got["strict"]["a"].source == "teacher" and got["strict"]["c"].coords is None
    assert got["keep"]["c"].detected == 1 and got["keep"]["c"].coords[0] == -0.1
    assert set(got["detected_only"]) == {"a"}
    assert {n: r.detected for n, r in got["lenient"].items()} == {"a": 1, "b": 0, "c": 1, "d": 1, "e": 1, "f": 1, "g": 0, "h": 2}
    only = R.read_predictions(spark, str(tmp_path), wanted=spark.createDataFrame([("b",)], "name string"))
    assert [r.name for r in only.collect()] == ["b"]


def test_tables(spark, tmp_path):
    put(tmp_path / "e.csv", "split,image,name,iou\ntrain,x.jpg,,0.5\ntrain,,x.jpg,0.7\nval,y.jpg,,inf\n,z.jpg,,0.5\nval,w.jpg,,bad\n")
    got = R.read_eval_csv(spark, str(tmp_path / "e.csv")).collect()
    assert [(r.split, r.name, r.iou) for r in got] == [("train", "x.jpg", 0.7)]
    put(tmp_path / "a.csv", "split,filename,teacher_detected,teacher_conf,iou,err_mean_px,err_max_px,w,h\ntrain,x,true,,,1.5,,640.0,480\n")
    r = R.read_audit_csv(spark, str(tmp_path / "a.csv")).first()
    assert (r.detected, r.conf, r.iou, r.err_mean_px, r.w) == (True, 0.0, None, 1.5, 640)
    put(tmp_path / "i.jsonl", "\n".join([
        json.dumps({"split": "train", "name": "a", "overlay_rel": "o"}), "{bad", json.dumps({"split": "test", "name": "a", "overlay_rel": "o"}),
        json.dumps({"split": "val", "name": "b", "overlay_rel": "o", "error": "x"}), json.dumps({"split": "val", "name": " ", "overlay_rel": "o"})]))
    assert [(r.name, r.is_negative) for r in R.read_review_index(spark, str(tmp_path / "i.jsonl")).collect()] == [("a", False)]
    put(tmp_path / "r.json", json.dumps({"params": {}, "samples": [{"filename": "a", "iou": 0.1}, {"filename": "a", "iou": 0.2}, {"iou": 3}]}, indent=1))
    assert [(r.filename, r.iou) for r in R.read_nested_report(spark, str(tmp_path / "r.json")).collect()] == [("a", 0.2)]
    put(tmp_path / "h.json", json.dumps({"train": [{"loss": 1.0}, {"loss": 0.5}], "val": [{"mean_iou": 0.8}]}))
    assert {(r.part, r.epoch, r.metric, r.value) for r in R.read_training_history(spark, str(tmp_path / "h.json")).collect()} == {
        ("train", 1, "loss", 1.0), ("train", 2, "loss", 0.5), ("val", 1, "mean_iou", 0.8)}
    put(tmp_path / "m.json", json.dumps([{"mean_iou": 0.5}, {"mean_iou": 0.6, "extra": 1}]))
    assert R.read_metric_reports(spark, str(tmp_path / "m.json")).count() == 2


def test_worst_report(spark, tmp_path):
    put(tmp_path / "w.txt", "Split  Filename IoU\n====\ntrain a.jpg 0.5 1.0 2.0 0.9\nval b.jpg 0.25 3 4\nbad c.jpg x y z\n\nSUMMARY\n  IoU: mean=1\n")
    got = R.read_worst_report(spark, str(tmp_path / "w.txt")).collect()
    assert [(r.name, r.score) for r in got] == [("a.jpg", 0.9), ("b.jpg", 1.0)]


def test_files_and_names(spark, tmp_path):
    for n in ("a.jpg", "b.PNG", "c.txt"):
        put(tmp_path / "img" / n, "x")
    assert {(r.stem, r.ext) for r in R.list_files(spark, str(tmp_path / "img"), [".jpg", ".PNG"]).collect()} == {("a", ".jpg"), ("b", ".PNG")}
    put(tmp_path / "n.txt", " a \nb\n\na\n")
    assert {r.name for r in R.read_name_set(spark, str(tmp_path / "n.txt")).collect()} == {"a", "b"}
    assert R.read_name_set(spark, str(tmp_path / "none.txt")).count() == 0


def test_versions_survive_a_broken_write(spark, tmp_path):
    path = str(tmp_path / "t")
    W.write_version(spark.range(3), path)
    (tmp_path / "t" / "v=2").mkdir()                # a write that never finished
    assert W.latest_version(spark, path) == 1
    W.write_version(spark.range(5), path)
    assert W.latest_version(spark, path) == 2 and W.read_version(spark, path).count() == 5
    assert W.read_version(spark, path, 1).count() == 3
    assert W.write_version(spark.range(9), path, dry_run=True) is None


def test_halves_round_to_even(spark):
    df = spark.createDataFrame([([0.1015625, 0.0078125] * 4,)], "q array<double>")
    assert df.select(W.label_line(F.col("q"))).first()[0] == "0 " + " ".join(["%.6f" % v for v in [0.1015625, 0.0078125] * 4])


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).select(F.col("id").cast("string").alias("name"))
    b = a.orderBy(F.desc("name"))
    assert W.dataset_fingerprint(a).first() == W.dataset_fingerprint(b).first()
    assert W.dataset_fingerprint(a).first() != W.dataset_fingerprint(a.where("name <> '7'")).first()
