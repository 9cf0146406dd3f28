"""ARR-*: decoders over numeric arrays. The embeddings serve as logits, heat maps and pixel grids."""

from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.shared import q6, r6, sel, spread
from quadlab.functions import arrays as A
from quadlab.functions.fence import computed

# long form of an embedding: vec_id, i (0-based), v
LONG = ("SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, "
        "(SELECT unnest(range(64)) AS i) n")


def chunks(v, size: int, reverse: bool = False):
    """The 64 values as rows of ``size``."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(64 // size - 1)), lambda i: F.slice(v, i * size + 1, size))
    return F.reverse(rows) if reverse else rows


@query("arr_01_sigmoid", sel(f"SELECT vec_id, {q6('1 / (1 + exp(-greatest(-60e0, least(60e0, CAST(embedding[1] AS DOUBLE) * 100))))', 's')} FROM embeddings"))
def sigmoid(spark, sf):
    return X.grids(spark, sf).select("vec_id", r6(A.sigmoid(F.get("v", F.lit(0)) * 100.0), "s"))


def _bins_sql(tau: str, src: str, bins: int) -> str:
    """src: vec_id, ch (0..7; x then y), b, v."""
    top = f"SELECT *, max(v / {tau}) OVER (PARTITION BY vec_id, ch) AS m FROM {src}"
    ex = (f"SELECT vec_id, ch, least(greatest(sum(exp(v / {tau} - m) * b / {bins - 1}e0) / (sum(exp(v / {tau} - m)) + 1e-8), 0e0), 1e0) AS e "
          f"FROM ({top}) t GROUP BY vec_id, ch")
    return "SELECT vec_id, " + ", ".join(
        q6(f"max(CASE WHEN ch = {i // 2 + 4 * (i % 2)} THEN e END)", f"o{i}") for i in range(8)) + f" FROM ({ex}) e GROUP BY vec_id"


# x rows are the four chunks of 16 values, y rows the same chunks in reverse order
BINS = (f"(SELECT vec_id, i // 16 AS ch, i % 16 AS b, v FROM ({LONG}) l UNION ALL "
        f"SELECT vec_id, 7 - i // 16 AS ch, i % 16 AS b, v FROM ({LONG}) l)")


@query("arr_02_decode_bins", _bins_sql("0.5e0", BINS, 16))
def decode_bins(spark, sf):
    x, y = chunks(F.col("v"), 16), chunks(F.col("v"), 16, True)
    return X.grids(spark, sf).select("vec_id", *spread(A.decode_bins(x, y, 0.5), "o", 6))


@query("arr_02_decode_bins_packed", _bins_sql("1e0", f"(SELECT vec_id, i % 8 AS ch, i // 8 AS b, v FROM ({LONG}) l)", 8))
def decode_bins_packed(spark, sf):
    return X.grids(spark, sf).select("vec_id", *spread(A.decode_bins_packed(chunks(F.col("v"), 8), 1.0, bins_first=True), "o", 6))


@query("arr_03_dequantize", "SELECT vec_id, i, (v - 3) * 0.125e0 AS v FROM (SELECT vec_id, i, round(v * 100) AS v "
       f"FROM ({LONG}) l) q WHERE i < 8")
def dequantize(spark, sf):
    q = F.transform(F.slice("v", 1, 8), lambda v: F.round(v * 100.0))
    rows = X.grids(spark, sf).select("vec_id", F.posexplode(A.dequantize(q, F.lit(0.125), F.lit(3.0))).alias("i", "v"))
    return rows


HEAT = f"(SELECT vec_id, i // 16 AS ch, i % 4 AS x, (i // 4) % 4 AS y, i % 16 AS cell, abs(v) AS v FROM ({LONG}) l)"


def heat(spark, sf):
    return X.grids(spark, sf).select("vec_id", F.transform(chunks(F.col("v"), 16), lambda c: F.transform(c, lambda v: F.abs(v))).alias("h"))


def _channels(x: str, y: str, src: str) -> str:
    return "SELECT vec_id, " + ", ".join(
        q6(f"max(CASE WHEN ch = {i // 2} THEN {x if i % 2 == 0 else y} END)", f"o{i}") for i in range(8)) + f" FROM ({src}) e GROUP BY vec_id"


@query("arr_04_decode_heat_soft", _channels("ex", "ey", "SELECT vec_id, ch, least(greatest(sum(v * x) / (sum(v) + 1e-9) / 3, 0), 1) AS ex, "
       f"least(greatest(sum(v * y) / (sum(v) + 1e-9) / 3, 0), 1) AS ey FROM {HEAT} h GROUP BY vec_id, ch"))
def decode_heat_soft(spark, sf):
    return heat(spark, sf).select("vec_id", *spread(A.decode_heat_soft(F.col("h"), 4, 4), "o", 6))


@query("arr_05_decode_heat_argmax", _channels("x / 3e0", "y / 3e0", "SELECT vec_id, ch, x, y FROM (SELECT *, row_number() OVER "
       f"(PARTITION BY vec_id, ch ORDER BY v DESC, cell) AS rn FROM {HEAT} h) r WHERE rn = 1"))
def decode_heat_argmax(spark, sf):
    return heat(spark, sf).select("vec_id", *spread(A.decode_heat_argmax(F.col("h"), 4, 4), "o", 6))


def _centroid_sql() -> str:
    ch = ("SELECT vec_id, ch, max(v) AS peak, sum(CASE WHEN v >= 0.25 THEN v END) AS m, "
          "sum(CASE WHEN v >= 0.25 THEN v * x END) AS mx, sum(CASE WHEN v >= 0.25 THEN v * y END) AS my "
          f"FROM {HEAT} h GROUP BY vec_id, ch")
    pts = ("SELECT vec_id, ch, peak, m IS NOT NULL AS ok, least(greatest(mx / m / 3e0 * 639e0 / 640e0, 0), 1) AS ex, "
           f"least(greatest(my / m / 3e0 * 479e0 / 480e0, 0), 1) AS ey FROM ({ch}) c")
    return "SELECT vec_id, CAST(bool_and(ok) AS INT) AS detected, " + q6(
        "CASE WHEN bool_and(ok) THEN least(avg(peak), 1) ELSE 0 END", "conf") + ", " + ", ".join(
        q6(f"CASE WHEN bool_and(ok) THEN max(CASE WHEN ch = {i // 2} THEN {'ex' if i % 2 == 0 else 'ey'} END) ELSE -1 END", f"o{i}")
        for i in range(8)) + f" FROM ({pts}) p GROUP BY vec_id"


@query("arr_06_decode_heat_centroid", _centroid_sql())
def decode_heat_centroid(spark, sf):
    rows = heat(spark, sf).withColumn("d", A.decode_heat_centroid(F.col("h"), 4, 4, 0.25, F.lit(640.0), F.lit(480.0)))
    return rows.select("vec_id", "d.detected", r6("d.conf", "conf"), *spread(F.col("d.coords"), "o", 6))


@query("arr_07_difference_hash", "SELECT vec_id, string_agg(CASE WHEN v > n THEN '1' ELSE '0' END, '' ORDER BY i) AS hash FROM "
       f"(SELECT *, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS n FROM ({LONG}) l) z WHERE i % 8 < 7 GROUP BY vec_id")
def difference_hash(spark, sf):
    return X.grids(spark, sf).select("vec_id", A.difference_hash(F.col("v"), 8).alias("hash"))


# pixels: the embedding shifted and stretched to a grey range
PIXEL = "v * 100 + 40 + (vec_id % 5) * 50"


def _stats_sql() -> str:
    px = f"SELECT vec_id, i % 8 AS x, i // 8 AS y, {PIXEL} AS p FROM ({LONG}) l"
    col3 = f"SELECT *, sum(p) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM ({px}) a"
    box9 = f"SELECT *, sum(c) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM ({col3}) b"
    return (f"SELECT vec_id, avg(p) AS mean, stddev_pop(p) AS std, var_pop(CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 "
            f"THEN 9 * p - s END) AS edge_var FROM ({box9}) d GROUP BY vec_id")


def _quality_sql() -> str:
    w, h = "(100 + (vec_id % 7) * 100)", "(120 + (vec_id % 11) * 50)"
    tests = [
        (f"{w} < 200 OR {h} < 200", f"'low_resolution:' || {w} || 'x' || {h}"),
        ("mean < 30", "printf('very_dark:brightness=%.1f', mean)"),
        ("mean >= 30 AND mean < 50", "printf('dark:brightness=%.1f', mean)"),
        ("mean > 240", "printf('very_bright:brightness=%.1f', mean)"),
        ("mean > 220 AND mean <= 240", "printf('bright:brightness=%.1f', mean)"),
        ("std < 20", "printf('low_contrast:stddev=%.1f', std)"),
        ("edge_var < 100", "printf('possibly_blurry:variance=%.1f', edge_var)"),
        (f"greatest({w} / {h}, {h} / {w}) > 3", f"printf('unusual_image_aspect:%.1f', greatest({w} / {h}, {h} / {w}))"),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in tests)
    return f"SELECT vec_id, i AS issue FROM (SELECT vec_id, unnest([{items}]) AS i FROM ({_stats_sql()}) s) z WHERE i IS NOT NULL"


def pixel_grids(spark, sf):
    shift = F.lit(40.0) + (F.col("vec_id") % 5) * 50.0
    return X.grids(spark, sf).withColumn("g", F.transform("v", lambda v: v * 100.0 + shift))


def quality(spark, sf):
    """vec_id, issues: quality rules over the statistics of each grid."""
    rows = computed(pixel_grids(spark, sf), {"s": A.grid_stats(F.col("g"), 8)})
    w, h = F.lit(100) + (F.col("vec_id") % 7) * 100, F.lit(120) + (F.col("vec_id") % 11) * 50
    issues = A.image_quality_issues(w.cast("double"), h.cast("double"), F.col("s.mean"), F.col("s.std"), F.col("s.edge_var"))
    return rows.select("vec_id", issues.alias("issues"))


@query("arr_08_image_quality_issues", _quality_sql())
def image_quality_issues(spark, sf):
    return quality(spark, sf).select("vec_id", F.explode("issues").alias("issue"))
