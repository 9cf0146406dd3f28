"""Connected components of a graph given as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadlab.llm.common import clean, cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has either one smaller neighbour or larger ones only."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("low"), F.lit(0).alias("root")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("low"), F.lit(1).alias("root")))))
    nodes = ends.groupBy("node").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.max("root").alias("root"))
    return nodes.where("a != b or a is not null and root = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    ``edges`` has long columns ``a`` and ``b``; the result has ``node`` and ``component``. Alternates large-star and
    small-star steps until every node hangs on the smallest node of its component, which a count by node tells. Each step is aggregations by node
    with map-side partial minimums and an equi-join, so a hub with very many neighbours is never gathered in one place;
    the links of a step are checkpointed. Null ends and self-links are ignored, repeated links count once, no rows give no rows.
    """
    e = (edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = cut(e)
    while not _are_stars(e):
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        e = cut(small.where("u != v").distinct())
        del both, low, large, down, small
    clean(e)
    roots = e.select(F.col("v").alias("node")).distinct()
    return (e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component")))
            .groupBy("node").agg(F.min("component").alias("component")))
