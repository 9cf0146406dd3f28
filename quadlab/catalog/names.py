"""FN-*: name and flag functions."""

from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.shared import num, sel
from quadlab.functions import geometry as G, names as N


def name():
    return F.col("name")


@query("fn_01_stem", sel("SELECT name, name[:-5] AS stem FROM quad_samples"))
def stem(spark, sf):
    full = F.concat(F.lit("images/"), name())
    return X.samples(spark, sf).select("name", N.stem(full).alias("stem"))


@query("fn_02_is_negative", sel(
    "SELECT name, CAST(starts_with(name, 'negative_') AS INT) AS plain, "
    "CAST(lower(name) LIKE 'negative\\_%' ESCAPE '\\' AS INT) AS any_case, "
    "CAST(split_part(name, '_', 1) = 'negative' AS INT) AS token, "
    "CAST(g0 IS NULL AS INT) AS zero_label FROM quad_samples"))
def is_negative(spark, sf):
    rows = X.samples(spark, sf).join(X.labels(spark, sf).select("stem", "coords"), "stem", "left")
    zero = F.coalesce("coords", F.array_repeat(F.lit(0.0), 8))
    return rows.select("name", num(N.is_negative(name())).alias("plain"), num(N.is_negative(name(), True)).alias("any_case"),
                       num(N.is_negative_token(name())).alias("token"), num(N.is_zero_label(zero)).alias("zero_label"))


@query("fn_03_source_prefix", sel(
    "SELECT name, split_part(name, '_', 1) || '_' || split_part(name, '_', 2) AS prefix, "
    "lower(split_part(name, '_', 1)) AS token FROM quad_samples"))
def source_prefix(spark, sf):
    return X.samples(spark, sf).select("name", N.source_prefix(name()).alias("prefix"), N.first_token(name()).alias("token"))


@query("fn_04_has_prefix", sel(
    "SELECT name, CAST(regexp_matches(lower(name), '^(id_card|midv)') AS INT) AS wanted, "
    "CAST(regexp_matches(name, '^(id|card)') AS INT) AS glob, "
    "CAST(NOT regexp_matches(name, '^idcard') AS INT) AS other FROM quad_samples"))
def has_prefix(spark, sf):
    return X.samples(spark, sf).select(
        "name", num(N.has_prefix(name(), ["ID_card", "MIDV"])).alias("wanted"),
        num(N.has_prefix(name(), ["id", "card"], ignore_case=False)).alias("glob"),
        num(~N.has_prefix(name(), ["idcard"], ignore_case=False)).alias("other"))


@query("fn_05_is_protected", sel(
    "SELECT name, CAST(name LIKE 'MIDV%' OR name ILIKE 'smartdoc%' AS INT) AS protected FROM quad_samples"))
def is_protected(spark, sf):
    return X.samples(spark, sf).select("name", num(N.is_protected(name())).alias("protected"))


@query("fn_06_flags", sel(
    "SELECT sample_id, concat_ws(',', CASE WHEN g0 < 0.01 THEN 'border' END, CASE WHEN g2 - g0 < 0.2 THEN 'small' END, "
    "CASE WHEN g4 < g0 + 0.2 THEN 'weird' END) AS flags FROM quad_samples WHERE g0 IS NOT NULL"))
def flags(spark, sf):
    x = G.xs(F.col("coords"))
    return X.labels(spark, sf).select("sample_id", N.flag_list(
        border=x[0] < 0.01, small=x[1] - x[0] < 0.2, weird=x[2] < x[0] + 0.2).alias("flags"))


@query("fn_07_issue_type", sel(
    "SELECT split_part(i, ':', 1) AS issue_type, count(*) AS n FROM (SELECT unnest(['touches_left_edge:' || "
    "CAST(sample_id AS VARCHAR), 'non_convex_quad']) AS i FROM quad_samples) GROUP BY 1"))
def issue_type(spark, sf):
    rows = X.samples(spark, sf).select(F.explode(F.array(
        F.concat(F.lit("touches_left_edge:"), F.col("sample_id").cast("string")), F.lit("non_convex_quad"))).alias("i"))
    return rows.groupBy(N.issue_type(F.col("i")).alias("issue_type")).agg(F.count("*").alias("n"))
