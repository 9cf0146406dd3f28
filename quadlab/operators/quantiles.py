"""Aggregates together with exact percentiles (linear interpolation).

The rows are written once, with the columns that are needed. A first pass computes the ordinary aggregates and, with a mergeable
sketch per value column, a bracket around each wanted rank; its result has one row per group. A second pass counts the rows below each
bracket, and those in each of ``CELLS`` equal parts of it, for which only rows inside a bracket are exploded; a third orders only the distinct values of the part that the rank
falls in, about one in ten million of a large group's. No group is collected or brought into one task: the brackets of up to ``FEW_GROUPS`` groups are broadcast,
those of more are repeated under ``SALTS`` salts. A group too small for its sketch to bracket a rank safely has the whole line as its bracket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadlab.checkpoints import cut

ACCURACY = 10000
#: Equal parts of a bracket.
CELLS = 4096
#: Up to so many groups their brackets are sent to all tasks.
FEW_GROUPS = 10000
#: Beyond, the rows of a group are dealt over so many tasks.
SALTS = 64


@dataclass(frozen=True)
class Percentile:
    """Percentile ``p`` (0..1) over all non-null values of ``values``, as column ``name``."""

    name: str
    p: float
    values: tuple[Column, ...]


def percentile(name: str, p: float, *values: Column | str) -> Percentile:
    return Percentile(name, p, tuple(F.col(v) if isinstance(v, str) else v for v in values))


def aggregate(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], percentiles: Sequence[Percentile],
              accuracy: int = ACCURACY, inputs: Sequence[str] | None = None) -> DataFrame:
    """One row per group with the aggregates and the exact percentiles (null without values).

    ``inputs`` names the columns that aggregates and percentiles read (all by default); the rows are written once with these.
    """
    rows = df if by else df.withColumn("__all", F.lit(0))
    keys = list(by) or ["__all"]
    if inputs is not None:
        rows = rows.select(*keys, *[c for c in dict.fromkeys(inputs) if c not in keys])
    rows = cut(rows)
    margin, inf = 2.0 / accuracy, float("inf")

    # one sketch per value column answers all bounds that are wanted of it
    values = {str(v): v for s in percentiles for v in s.values}
    at = {k: sorted({q for s in percentiles if k in map(str, s.values) for q in (s.p - margin, s.p + margin) if 0 < q < 1}) for k in values}
    sketches = []
    for j, (k, v) in enumerate(values.items()):
        sketches.append(F.count(v).alias(f"__n{j}"))
        if at[k]:
            sketches.append(F.percentile_approx(v.cast("double"), at[k], accuracy).alias(f"__q{j}"))
    first = cut(rows.groupBy(*keys).agg(*aggs, *sketches))

    def bracket(s: Percentile) -> Column:
        cols = [list(values).index(str(v)) for v in s.values]
        n = sum((F.col(f"__n{j}") for j in cols), F.lit(0))
        small = n * F.lit(margin) < 4 * len(cols)

        def bound(q: float, join, end: Column) -> Column:
            if not 0 < s.p < 1 or not 0 < q < 1:
                return end
            parts = [F.get(f"__q{j}", F.lit(at[list(values)[j]].index(q))) for j in cols]
            return F.when(small, end).otherwise(join(*parts) if len(parts) > 1 else parts[0])
        return F.struct(n.cast("bigint").alias("n"), bound(s.p - margin, F.least, F.lit(-inf)).alias("lo"),
                        bound(s.p + margin, F.greatest, F.lit(inf)).alias("hi"))
    bounds = first.select(*keys, *[bracket(s).alias(f"__b{i}") for i, s in enumerate(percentiles)])

    # a join by the keys would bring all rows of a group into one task
    few = first.count() <= FEW_GROUPS

    def beside(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
        if few:
            return rows.join(F.broadcast(side), on)
        salted = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"]).drop("__salt")

    # a row below a bracket only counts (cell -1); one above it is not needed. Beside broadcast brackets rows below are counted by a pass of their own, so that
    # only the few rows inside a bracket are exploded; a shuffled join is not made once more for that
    beside_all = beside(rows, bounds, keys)
    tags, below, inside = [], [], F.lit(False)
    for i, s in enumerate(percentiles):
        lo, hi, n = (F.col(f"__b{i}.{f}") for f in ("lo", "hi", "n"))
        under = F.lit(0)
        for v in s.values:
            v = v.cast("double")
            part = F.floor((v - lo) / (hi - lo) * CELLS)
            cell = F.when(v < lo, -1).when((hi == inf) | (lo == -inf) | (hi == lo), 0).otherwise(F.least(part, F.lit(CELLS - 1)))
            needed = (v >= lo) & (v <= hi) if few else v <= hi
            tags.append(F.when(needed, F.struct(F.lit(i).alias("i"), n.alias("n"), v.alias("v"), cell.cast("int").alias("cell"))))
            under, inside = under + F.count_if(v < lo), inside | needed
        below.append(F.struct(F.lit(i).alias("i"), F.min(n).alias("n"), F.lit(-1).alias("cell"), under.cast("bigint").alias("c")))
    tagged = beside_all.where(inside).select(*keys, F.explode(F.array_compact(F.array(*tags))).alias("t")).select(*keys, "t.*")
    p = F.get(F.array(*[F.lit(s.p) for s in percentiles]), F.col("i"))
    cells = Window.partitionBy(*keys, "i").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    counted = tagged.groupBy(*keys, "i", "n", "cell").agg(F.count("*").alias("c"))
    if few:
        counted = counted.unionByName(beside_all.groupBy(*keys).agg(F.array(*below).alias("t")).select(*keys, F.explode("t").alias("t")).select(*keys, "t.*").where("c > 0"))
    counted = counted.withColumns({"cum": F.sum("c").over(cells), "pos": (F.col("n") - 1) * p})
    wanted = (counted.where((F.col("cum") > F.floor("pos")) & (F.col("cum") - F.col("c") <= F.ceil("pos")))
              .select(*keys, "i", "cell", "pos", (F.col("cum") - F.col("c")).alias("before")))
    hist = beside(tagged, wanted, [*keys, "i", "cell"]).groupBy(*keys, "i", "pos", "before", "v").agg(F.count("*").alias("c"))
    line = Window.partitionBy(*keys, "i")
    run = line.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("cum", F.sum("c").over(run) + F.min("before").over(line))
    ends = ranked.groupBy(*keys, "i").agg(
        F.min(F.when(F.col("cum") > F.floor("pos"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("cum") > F.ceil("pos"), F.col("v"))).alias("b"),
        F.first(F.col("pos") - F.floor("pos")).alias("f"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    picked = ends.groupBy(*keys).agg(*[
        F.max(F.when(F.col("i") == i, value)).alias(s.name) for i, s in enumerate(percentiles)])
    out = first.drop(*[f"__{x}{j}" for j in range(len(values)) for x in "nq"]).join(picked, keys, "left")
    return out if by else out.drop("__all")


def exact_percentiles(df: DataFrame, wanted: dict[str, float], value: str, by: Sequence[str] = (),
                      accuracy: int = ACCURACY) -> DataFrame:
    """One column per entry of ``wanted`` (name -> p in [0,1]), one row per group."""
    specs = [percentile(name, p, value) for name, p in wanted.items()]
    return aggregate(df, by, [F.count(value).alias("__rows")], specs, accuracy, [value]).drop("__rows")
