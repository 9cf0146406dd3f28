"""ST-*, SM-*: set operations and sampling."""

from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.aggregates import NEG
from quadlab.catalog.shared import sel
from quadlab.operators import joins as J, metrics as M, sampling as S
from quadlab.operators.ranking import global_running

SEED = 1337


@query("st_01_union_all", sel("SELECT split, name FROM quad_samples UNION ALL SELECT split, name FROM quad_samples WHERE sample_id % 17 = 0"))
def union_all(spark, sf):
    s = X.samples(spark, sf)
    return S.union_all(s.select("split", "name"), J.only_names(s, X.outlier_names(spark, sf)).select("split", "name"))


@query("st_02_sorted_union", sel("SELECT name FROM quad_samples WHERE sample_id % 17 = 0 UNION SELECT name FROM quad_samples WHERE split = 'val'"))
def sorted_union(spark, sf):
    return S.sorted_union(X.outlier_names(spark, sf), X.samples(spark, sf).where("split = 'val'"))


@query("st_03_difference", sel("SELECT name FROM quad_samples WHERE sample_id % 17 = 0 EXCEPT SELECT name FROM quad_samples WHERE split = 'val'"))
def difference(spark, sf):
    return S.difference(X.outlier_names(spark, sf), X.samples(spark, sf).where("split = 'val'"))


@query("st_03_intersection", sel("SELECT name FROM quad_samples WHERE sample_id % 17 = 0 INTERSECT SELECT name FROM quad_samples WHERE split = 'val'"))
def intersection(spark, sf):
    return S.intersection(X.outlier_names(spark, sf), X.samples(spark, sf).where("split = 'val'"))


@query("sm_01_weighted_sample", sel(
    f"SELECT draw, name, is_outlier FROM (SELECT i AS draw, CAST(('0x' || substr(md5(i || '#{SEED}'), 1, 13)) AS BIGINT) / 4503599627370496e0 * total AS p FROM "
    "(SELECT unnest(range(n)) AS i, total FROM (SELECT count(*) AS n, CAST(sum(w) AS DOUBLE) AS total FROM w) t) z) d JOIN "
    "(SELECT name, is_outlier, sum(w) OVER (ORDER BY name) AS cum, sum(w) OVER (ORDER BY name) - w AS start FROM w) r ON p >= start AND p < cum",
    [("w", "SELECT name, CAST(sample_id % 17 = 0 AS INT) AS is_outlier, CASE WHEN sample_id % 17 = 0 THEN 3 ELSE 1 END AS w FROM quad_samples")]))
def weighted_sample(spark, sf):
    """As many draws as samples, outliers with weight 3."""
    rows = J.with_membership(X.samples(spark, sf).select("name"), X.outlier_names(spark, sf), "is_outlier")
    rows = rows.withColumn("weight", F.when(F.col("is_outlier") == 1, 3.0).otherwise(1.0))
    return S.weighted_sample(rows, "weight", SEED).select("draw", "name", "is_outlier")


HASH = f"md5(name || '#{SEED}')"


@query("sm_02_sample_negatives", sel(
    f"SELECT n.split, n.name FROM (SELECT split, name, row_number() OVER (PARTITION BY split ORDER BY {HASH}, name) AS rn FROM quad_samples WHERE {NEG}) n "
    f"JOIN (SELECT split, CAST(round_even(np * (nn / greatest(1, np)), 0) AS BIGINT) AS k FROM (SELECT split, count(*) FILTER (WHERE NOT {NEG} AND g0 IS NOT NULL) AS np, count(*) FILTER (WHERE {NEG}) * 0.5e0 AS nn FROM quad_samples GROUP BY split) c) k "
    f"ON n.split = k.split WHERE rn <= k"))
def sample_negatives(spark, sf):
    """Half of the original ratio, for the labelled positives."""
    s = X.samples(spark, sf)
    pos = J.join_labels(s, X.labels(spark, sf).select("stem", "coords"), "inner")
    n = pos.groupBy("split").agg(F.count("*").alias("np"))
    ratio = (M.negative_ratio(s).join(n, "split")
             .select("split", (F.col("n_neg") * 0.5 / F.greatest(F.lit(1), F.col("np"))).alias("neg_ratio")))
    return S.sample_negatives(s, pos, ratio, SEED).select("split", "name")


@query("sm_03_seeded_shuffle", sel(f"SELECT name, row_number() OVER (ORDER BY {HASH}, name) AS place FROM quad_samples"))
def seeded_shuffle(spark, sf):
    """Names with their place in the shuffled order."""
    rows = S.seeded_shuffle(X.samples(spark, sf).select("name"), SEED).withColumn("at", F.monotonically_increasing_id())
    return global_running(rows, ["at"], out="place").select("name", "place")


@query("sm_04_stratified_sample", sel(
    f"SELECT stratum, name FROM (SELECT stratum, name, row_number() OVER (PARTITION BY stratum ORDER BY {HASH}, name) AS rn FROM (SELECT name, "
    f"CASE WHEN {NEG} THEN 'negative' WHEN sample_id % 17 = 0 THEN 'outlier' ELSE 'positive' END AS stratum FROM quad_samples) z) y WHERE rn <= 25"))
def stratified_sample(spark, sf):
    rows = J.with_membership(X.samples(spark, sf), X.outlier_names(spark, sf), "is_outlier")
    rows = rows.withColumn("stratum", F.when(F.col("is_negative"), "negative").when(F.col("is_outlier") == 1, "outlier").otherwise("positive"))
    return S.stratified_sample(rows.select("name", "stratum"), 25, "stratum", SEED).select("stratum", "name")


@query("sm_05_calibration_set", sel(
    "SELECT name, v AS variant FROM (SELECT name FROM quad_samples ORDER BY sample_id LIMIT 100) z CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS v) n"))
def calibration_set(spark, sf):
    return S.calibration_set(X.samples(spark, sf), 100, variants=4).select("name", "variant")
