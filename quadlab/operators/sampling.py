"""Set operations and reproducible sampling in hash order.

A sample is the first rows in the order of ``md5(name, seed)``: the same on every cluster size, and
its cut point is found from a histogram of hash prefixes, never by sorting a whole split in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadlab.operators.ranking import global_running, top_n_per_group


def hash_key(name: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("#", name, F.lit(str(seed))))


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def sorted_union(*dfs: DataFrame) -> DataFrame:
    return union_all(*[d.select("name") for d in dfs]).distinct().orderBy("name")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").subtract(b.select("name"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").intersect(b.select("name"))


def first_k_by_hash(df: DataFrame, targets: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """Per group, the first ``k`` rows in hash order; ``targets`` holds the group columns and k.

    A histogram of the first three hex digits of the hash finds the bucket that the cut falls in, one of its next three digits
    the part of it; only that part, about one row in 16 million of the group, is ordered.
    """
    by = list(by)
    rows, left, parts = df.withColumn("__h", hash_key(F.col("name"), seed)), targets.select(*by, "k"), []
    for digits in (3, 6):
        rows = rows.withColumn("__b", F.substring("__h", 1, digits))
        hist = rows.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
        before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        plan = (hist.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).join(left, by)
                .select(*by, "__b", (F.col("k") - F.col("__before")).alias("__room"), "__c").where(F.col("__room") > 0))
        tagged = rows.join(plan, [*by, "__b"])
        parts.append(tagged.where(F.col("__room") >= F.col("__c")).select(*df.columns))
        rows = tagged.where(F.col("__room") < F.col("__c")).drop("__b", "__room", "__c")
        left = plan.where(F.col("__room") < F.col("__c")).select(*by, F.col("__room").alias("k"))
    w = Window.partitionBy(*by).orderBy("__h", "name")
    last = rows.withColumn("__rn", F.row_number().over(w)).join(left, by).where(F.col("__rn") <= F.col("k"))
    return union_all(*parts, last.select(*df.columns))


def sample_negatives(samples: DataFrame, positives: DataFrame, ratios: DataFrame, seed: int = 1337) -> DataFrame:
    """Per split: round-half-even(positives * ratio) negatives, at most all of them, without replacement."""
    n_pos = positives.groupBy("split").agg(F.count("*").alias("n_pos"))
    targets = n_pos.join(ratios.select("split", "neg_ratio"), "split").select(
        "split", F.bround(F.col("n_pos") * F.col("neg_ratio"), 0).cast("bigint").alias("k"))
    return first_k_by_hash(samples.where("is_negative"), targets, ["split"], seed)


def seeded_shuffle(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(hash_key(F.col("name"), seed), "name")


def stratified_sample(df: DataFrame, k: int, stratum: str, seed: int) -> DataFrame:
    keyed = df.withColumn("__h", hash_key(F.col("name"), seed))
    return top_n_per_group(keyed, k, [stratum], ["__h", "name"]).drop("__h", "rn")


def weighted_sample(df: DataFrame, weight: str, seed: int, n: int | None = None, name: str = "name") -> DataFrame:
    """``n`` draws with replacement (as many as rows by default), each row with chance weight / total.

    Rows, in name order, own consecutive ranges of the total weight (exact decimals with twelve places); draws are points, from the md5 of their number. Both sides
    are cut into cells as wide as the mean weight, so cells hold about one draw each and all rows together lie in
    at most three cells a row, however unequal the weights; a row that spans very many cells is spread block by block.
    """
    spark = df.sparkSession
    rows = df.where(F.col(weight) > 0).withColumn("__w", F.col(weight).cast("decimal(38,12)"))
    rows = global_running(rows, [name], ["__w"])
    total, count = rows.agg(F.sum("__w"), F.count("*")).first()
    if not count:
        return df.withColumn("draw", F.lit(None).cast("bigint")).limit(0)
    width, block = float(total) / count, 1 << 12

    def cell(c: Column) -> Column:
        return F.floor(c.cast("double") / width)
    owned = rows.withColumns({"__start": F.col("cum___w") - F.col("__w"), "__end": F.col("cum___w")})
    owned = owned.withColumns({"__from": cell(F.col("__start")), "__to": cell(F.col("__end"))})
    owned = owned.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__from") / block), F.floor(F.col("__to") / block))))
    owned = owned.withColumn("__cell", F.explode(F.sequence(
        F.greatest("__from", F.col("__block") * block), F.least("__to", F.col("__block") * block + block - 1))))
    number = F.conv(F.substring(F.md5(F.concat_ws("#", F.col("id").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("bigint")
    draws = spark.range(n or count).withColumn("__at", number / F.lit(float(1 << 52)) * F.lit(float(total))).withColumn("__cell", cell(F.col("__at")))
    hit = (F.col("__at") >= F.col("__start").cast("double")) & (F.col("__at") < F.col("__end").cast("double"))
    return draws.join(owned, "__cell").where(hit).select(*df.columns, F.col("id").alias("draw"))


def calibration_set(df: DataFrame, n: int, order: str = "ord", variants: int = 1) -> DataFrame:
    """First ``n`` rows in order, each repeated once per variant."""
    return df.orderBy(order).limit(n).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
