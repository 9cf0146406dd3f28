"""Components of sets that are alike, from the buckets their signatures share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadlab.llm.common import cut, release, written
from quadlab.llm.components import connected_components

#: Sets that would meet more than so many times for each row of their prefixes are first joined at a higher similarity.
CROWD = 4


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets have 100 * intersection >= percent * union."""
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
            .where((F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent)
                   & (100 * both >= percent * (F.size("sa") + F.size("sb") - both))).select("a", "b").distinct())


def ordered_sets(sets: DataFrame) -> DataFrame:
    """``id, n, e``: each set's size and its elements from rare to frequent, with their counts over all these sets."""
    el = sets.select("id", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("s"), F.explode("shingles").alias("g"))
    return (el.join(el.groupBy("g").agg(F.count("*").alias("c")), "g").groupBy("id", "n", "s")
            .agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("e")).drop("s"))


def prefix_rows(members: DataFrame, percent: int) -> DataFrame:
    """The elements by which sets can meet: those of their prefixes that another set has too.

    ``members`` has ``id, component`` and the columns of ``ordered_sets``. The smaller set of a pair (of equal ones, that with the smaller id) needs
    only the ``short`` prefix, that leaves out what it could not miss in a set of its size or larger.
    """
    whole = F.expr(f"n - cast(ceil(n * {percent} / 100D) as int) + 1")
    short = F.expr(f"n - cast(ceil(2 * n * {percent} / {100 + percent}D) as int) + 1")
    kept = members.select("id", "component", "n", short.alias("short"), F.slice("e", F.lit(1), whole).alias("e"))
    shared = F.filter("e", lambda x: x["c"] > 1)
    kept = kept.withColumns({"first": F.transform(shared, lambda x: x["g"]),
                             "head": F.transform(F.filter(F.slice("e", F.lit(1), F.col("short")), lambda x: x["c"] > 1), lambda x: x["g"])})
    return written(kept.select("id", "component", "n", "first", "head", "short", F.posexplode("e").alias("i", "x")).where("x.c > 1")
                   .select("id", "component", "n", "first", "head", "short", "i", "x.g"))


def _crowded(rows: DataFrame) -> bool:
    """Whether the sets of ``prefix_rows`` would meet sets of other components much more often than there are rows."""
    by = rows.groupBy("g", "component").agg(F.count("*").cast("double").alias("n")).groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    x = by.agg(F.sum(F.col("n") * F.col("n") - F.col("own")).alias("met"), F.sum("n").alias("n")).first()
    return (x["met"] or 0) > CROWD * (x["n"] or 0)


def prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``a, b`` of different components: every pair that is alike enough is among them.

    ``members`` is as for ``prefix_rows``. Two sets that are alike share an element of
    their prefixes, the first of them at places that leave room for the overlap they need. So sets that share only frequent elements
    behind many rare ones of their own, as edited copies of one text and pages of one template do, never meet; others meet once, at their first common element.
    """
    return _met(prefix_rows(members, percent), percent)


def _met(rows: DataFrame, percent: int) -> DataFrame:
    a = rows.where("i < short").select("g", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("head").alias("fa"))
    b = rows.select("g", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("first").alias("fb"))
    return (a.join(b, "g").where(f"ca != cb and (na < nb or na = nb and a < b) and na * 100 >= nb * {percent} and "
                                 f"{100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb) and array_intersect(fa, fb)[0] = g")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components_of_alike(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the sets that have a link, over all links within ``percent``.

    ``buckets`` has distinct ``key, id``, ``sets`` has ``id, shingles`` of each id. First the sets of a bucket are compared with one pivot, the one that shares most
    buckets with others (the original, among edited copies), which joins much of a group of copies without pairing it up. Sets of
    buckets that then still hold several components are compared across components by their prefixes at ``percent``, which finds every link that is left. Where
    that would make them meet very often, they are first compared at a higher similarity, which joins copies of copies. Links are confirmed on whole sets.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"))
    shared = buckets.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("shared"))
    pivot = buckets.join(shared, "id").groupBy("key").agg(F.max(F.struct("shared", "id")).alias("p")).select("key", F.col("p.id").alias("pivot"))
    pairs = cut(buckets.join(pivot, "key").where("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
    parts = cut(connected_components(confirmed(pairs, sets, percent)))
    open_ = _open(buckets, parts)
    ordered = written(ordered_sets(sets.join(open_.select("id").distinct(), "id", "left_semi")))

    def rows(p: int) -> DataFrame:
        return prefix_rows(ordered.join(open_.select("id", "component").distinct(), "id"), p)

    def joined(found: DataFrame, p: int) -> DataFrame:
        more = confirmed(cut(_met(found, p)), sets, percent)
        out = cut(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
        release(found)
        return out

    left = rows(percent)
    if _crowded(left):
        release(left)
        higher = (100 + 2 * percent) // 3
        parts = joined(rows(higher), higher)
        open_ = _open(open_.drop("component"), parts)
        left = rows(percent)
    parts = joined(left, percent)
    release(ordered)
    return parts


def _open(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Members, with components, of the buckets that hold several components."""
    placed = buckets.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    return written(placed.join(several, "key", "left_semi"))
