"""Tables derived from the driver's parquet, written once as SQL expressions for both engines.

``sql(view)`` gives the view as SQL over the base tables; the functions below give the same view as a
DataFrame in the library's column layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# multiplier, modulus, offset of each base coordinate (units of 1/1024)
_BASE = [(37, 200, 100), (53, 200, 100), (41, 250, 700), (59, 200, 100),
         (43, 250, 700), (61, 250, 700), (47, 200, 100), (67, 250, 700)]
BASE = [f"CAST(({o} + (k * {m}) % {n}) AS DOUBLE) / CAST(1024 AS DOUBLE)" for m, n, o in _BASE]

NAME = ("concat(CASE k % 10 WHEN 0 THEN 'MIDV_a' WHEN 1 THEN 'smartdoc_ch1' WHEN 2 THEN 'id_card' "
        "WHEN 3 THEN 'id_detections' WHEN 4 THEN 'idcard_final' WHEN 5 THEN 'card_corner' WHEN 6 THEN 'receipt_jp' "
        "WHEN 7 THEN 'book_page' ELSE 'negative' END, '_', CAST(k AS STRING), '.jpg')")
SPLIT = "CASE WHEN (k - k % 10) % 50 = 0 THEN 'val' ELSE 'train' END"


def _px(n: int) -> str:
    return f"CAST({n} AS DOUBLE) / CAST(1024 AS DOUBLE)"


def _label(i: int) -> str:
    bowtie = {4: "b6", 5: "b7", 6: "b4", 7: "b5"}.get(i, f"b{i}")
    cases = ["WHEN k % 101 = 0 OR k % 10 >= 8 THEN NULL", f"WHEN k % 97 = 0 THEN {bowtie}",
             f"WHEN k % 89 = 0 THEN 0.25e0 + b{i} * 0.125e0"]
    if i in (0, 6):
        cases.append(f"WHEN k % 83 = 0 THEN {_px(2)}")
    if i in (4, 5):
        cases.append(f"WHEN k % 79 = 0 THEN b{i - 4} + {_px(60)}")
    if i == 2:
        cases.append(f"WHEN k % 103 = 0 THEN b2 + {_px(300)}")
    return f"CASE {' '.join(cases)} ELSE b{i} END"


LABEL = [_label(i) for i in range(8)]


def _jittered(i: int) -> str:
    off = 7919 * i
    return (f"CASE WHEN k % 107 = 0 THEN b{i} * 0.25e0 + CAST(s - 11 AS DOUBLE) * 0.125e0 ELSE b{i} + "
            f"CASE WHEN k % 29 = 0 THEN {_px(150)} ELSE 0e0 END + CASE WHEN k % (s + 8) = 0 "
            f"THEN CAST(((k * s + {off}) % 401 - 200) AS DOUBLE) / CAST(1024 AS DOUBLE) "
            f"ELSE CAST(((k * s + {off}) % (2 * amp + 1) - amp) AS DOUBLE) / CAST(1024 AS DOUBLE) END END")


JITTERED = [_jittered(i) for i in range(8)]
AMP = ("CASE (k + s) % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 12 WHEN 4 THEN 24 WHEN 5 THEN 60 "
       "ELSE 3 END")
DETECTED = ("CASE WHEN k % 10 >= 8 THEN CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END "
            "WHEN k % 321 = 0 THEN CASE WHEN s = 11 THEN 1 ELSE 0 END WHEN k % (s + 2) = 0 THEN 0 ELSE 1 END")
CONF = "1e0 - CAST(((k * s) % 256) AS DOUBLE) / CAST(1024 AS DOUBLE)"


def _pred(i: int) -> str:
    rolled = f"CASE WHEN source = 'teacher' AND k % 31 = 0 THEN p{(i + 2) % 8} ELSE p{i} END"
    return f"CASE WHEN detected = 1 THEN least(greatest({rolled}, 0e0), 1e0) ELSE -1e0 END"


PRED = [_pred(i) for i in range(8)]
SOURCE_ROWS = [("teacher", 11), ("winner", 13), ("docaligner", 17)]
IMAGE_ROWS = [(".jpg", 0, 2), (".jpeg", 1, 3), (".png", 2, 5)]
ACTION = "CASE event_type WHEN 'error' THEN 'discard' WHEN 'signup' THEN 'undiscard' ELSE 'modify' END"
# image sizes; every 211th image does not exist
WIDTH, HEIGHT = "CAST(640 + (k % 5) * 64 AS INT)", "CAST(480 + (k % 7) * 32 AS INT)"


def _named(exprs: list[str], prefix: str) -> list[str]:
    return [f"{e} AS {prefix}{i}" for i, e in enumerate(exprs)]


def sql(view: str) -> str:
    """The view as SQL over the base tables."""
    base = f"SELECT o_orderkey AS k, {', '.join(_named([b.replace('k *', 'o_orderkey *') for b in BASE], 'b'))} FROM orders"
    if view == "quad_samples":
        return (f"SELECT k AS sample_id, {NAME} AS name, {SPLIT} AS split, {', '.join(_named(LABEL, 'g'))} FROM ({base}) t")
    if view == "quad_predictions":
        m = " UNION ALL ".join(f"SELECT '{n}' AS source, {s} AS s" for n, s in SOURCE_ROWS)
        t = f"SELECT t.*, m.source, m.s, {AMP} AS amp FROM ({base}) t CROSS JOIN ({m}) m WHERE k % (s * 5) <> 0"
        q = f"SELECT k, source, {DETECTED} AS detected, {CONF} AS conf, {', '.join(_named(JITTERED, 'p'))} FROM ({t}) w"
        return (f"SELECT k AS sample_id, {NAME} AS name, {SPLIT} AS split, source, detected, conf, "
                f"{', '.join(_named(PRED, 'c'))} FROM ({q}) q")
    if view == "quad_images":
        m = " UNION ALL ".join(f"SELECT '{e}' AS ext, {p} AS priority, {d} AS md" for e, p, d in IMAGE_ROWS)
        return (f"SELECT k AS sample_id, regexp_replace({NAME}, '\\.jpg$', '') AS stem, ext, priority "
                f"FROM (SELECT o_orderkey AS k FROM orders) t CROSS JOIN ({m}) m WHERE k % md = 0")
    if view == "image_sizes":
        return (f"SELECT k AS sample_id, {NAME} AS name, {WIDTH} AS w, {HEIGHT} AS h "
                f"FROM (SELECT o_orderkey AS k FROM orders) t WHERE k % 211 <> 0")
    if view == "review_events":
        return (f"SELECT event_id AS seq, user_id * 7 AS sample_id, {ACTION} AS action, "
                f"CAST(event_id % 64 AS DOUBLE) / 1024e0 AS shift FROM events WHERE event_type <> 'view'")
    if view == "latency_runs":
        return "SELECT event_type AS model, value AS ms FROM events"
    if view == "train_history":
        return ("SELECT CAST(day(ts) AS INT) AS epoch, CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS DOUBLE) "
                "/ CAST(count(*) AS DOUBLE) AS mean_iou FROM events GROUP BY day(ts)")
    if view == "doc_hashes":
        return "SELECT doc_id AS sample_id, md5(text) AS h FROM documents"
    raise KeyError(view)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k")
    cores = spark.sparkContext.defaultParallelism
    # a table of one small file would otherwise keep a single core busy
    return keys.repartition(cores) if keys.rdd.getNumPartitions() < cores else keys


# The same coordinates as the SQL views, with one array expression instead of eight columns.
_PARAMS = ", ".join(f"named_struct('m', {m}L, 'n', {n}L, 'o', {o}L)" for m, n, o in _BASE)
_BASE_ARRAY = f"transform(array({_PARAMS}), p -> CAST(p.o + (k * p.m) % p.n AS DOUBLE) / 1024D)"
_LABEL_ARRAY = """CASE
    WHEN k % 97 = 0 THEN concat(slice(b, 1, 4), slice(b, 7, 2), slice(b, 5, 2))
    WHEN k % 89 = 0 THEN transform(b, v -> 0.25D + v * 0.125D)
    ELSE transform(b, (v, i) -> CASE WHEN k % 83 = 0 AND i IN (0, 6) THEN 2D / 1024D
        WHEN k % 79 = 0 AND i IN (4, 5) THEN get(b, i - 4) + 60D / 1024D
        WHEN k % 103 = 0 AND i = 2 THEN v + 300D / 1024D ELSE v END) END"""
_JITTER_ARRAY = """CASE
    WHEN k % 107 = 0 THEN transform(b, v -> v * 0.25D + CAST(s - 11 AS DOUBLE) * 0.125D)
    ELSE transform(b, (v, i) -> v + IF(k % 29 = 0, 150D / 1024D, 0D)
        + CAST(IF(k % (s + 8) = 0, (k * s + 7919 * i) % 401 - 200, (k * s + 7919 * i) % (2 * amp + 1) - amp) AS DOUBLE) / 1024D)
    END"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, ord, name, stem, prefix, is_negative, sample_id."""
    return _keys(spark, sf_dir).selectExpr(
        "k AS sample_id", "k AS ord", f"{NAME} AS name", f"{SPLIT} AS split").selectExpr(
        "split", "ord", "name", r"regexp_replace(name, '\\.[^.]*$', '') AS stem",
        "substring_index(name, '_', 2) AS prefix", "startswith(name, 'negative_') AS is_negative", "sample_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, coords (rows with a label only), sample_id, name."""
    return (_keys(spark, sf_dir).where("NOT (k % 101 = 0 OR k % 10 >= 8)")
            .selectExpr("k", f"{NAME} AS name", f"{_BASE_ARRAY} AS b")
            .selectExpr("k AS sample_id", "name", r"regexp_replace(name, '\\.[^.]*$', '') AS stem", f"{_LABEL_ARRAY} AS coords"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, source, name, detected, conf, coords, sample_id."""
    rows = ", ".join(f"named_struct('source', '{n}', 's', {s})" for n, s in SOURCE_ROWS)
    rolled = "IF(source = 'teacher' AND k % 31 = 0, concat(slice(p, 3, 6), slice(p, 1, 2)), p)"
    return (_keys(spark, sf_dir).selectExpr("k", f"{NAME} AS name", f"{SPLIT} AS split", f"{_BASE_ARRAY} AS b",
                                            f"inline(array({rows}))").where("k % (s * 5) <> 0")
            .selectExpr("k", "name", "split", "source", "s", f"{AMP} AS amp", "b", f"{DETECTED} AS detected", f"{CONF} AS conf")
            .selectExpr("k", "name", "split", "source", "detected", "conf", f"{_JITTER_ARRAY} AS p")
            .selectExpr("split", "source", "name", "detected", "conf",
                        f"IF(detected = 1, transform({rolled}, v -> least(greatest(v, 0D), 1D)), array_repeat(-1D, 8)) AS coords",
                        "k AS sample_id"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"named_struct('ext', '{e}', 'priority', {p}, 'md', {d})" for e, p, d in IMAGE_ROWS)
    return (_keys(spark, sf_dir).selectExpr("k", f"inline(array({rows}))").where("k % md = 0")
            .selectExpr("k AS sample_id", rf"regexp_replace({NAME}, '\\.jpg$', '') AS stem", "ext", "priority"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).where("k % 211 <> 0").selectExpr(
        "k AS sample_id", f"{NAME} AS name", f"{WIDTH} AS w", f"{HEIGHT} AS h")


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, sample_id, name, action, shift. An edit moves the label by ``shift``."""
    return table(spark, sf_dir, "events").where("event_type <> 'view'").selectExpr(
        "event_id AS seq", "user_id * 7 AS k", f"{ACTION} AS action",
        "CAST(event_id % 64 AS DOUBLE) / 1024e0 AS shift").selectExpr(
        "seq", "k AS sample_id", f"{NAME} AS name", "action", "shift")


def latency_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_type AS model", "value AS ms")


def train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.dayofmonth("ts").alias("epoch")).agg(
        (F.count_if(F.col("event_type") == "purchase").cast("double") / F.count("*").cast("double")).alias("mean_iou"))


def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS sample_id", "md5(text) AS h")


def outlier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("sample_id % 17 = 0").select("name")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v: the embedding as 64 doubles, read as an 8x8 grid, 4x16 logits or 4x4x4 heat."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
