"""Ordering, top-k, cuts and paging.

Nothing here sorts the whole input in one task: global positions come from range partitions and
their sizes, and cuts look at a histogram first and order only the bucket the cut falls in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadlab.checkpoints import cut

BUCKETS = 10000


def global_running(df: DataFrame, order: Sequence[str], sums: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Add the 1-based position in ``order`` and, per column of ``sums``, its running total ``cum_<column>``.

    Rows are range-partitioned on all order columns (ties on the first are split by the next), the
    partitions are fixed by a checkpoint, and each gets the totals of the ones before it.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ids rise by one in each partition, in the order it was sorted in: the place of a row needs no window over its partition
    at = F.monotonically_increasing_id()
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", at))
    ranged = ranged.withColumn("__pid", F.shiftright("__id", 33).cast("int"))
    # at most n rows from here to the join
    totals = ranged.groupBy("__pid").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in sums])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c)
                                       for c in ["__n", *[f"__s_{c}" for c in sums]]])
    rows = ranged.join(F.broadcast(offsets), "__pid")
    rows = rows.withColumn(out, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__n") + 1)
    running = Window.partitionBy("__pid").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    for c in sums:
        rows = rows.withColumn(f"cum_{c}", F.sum(c).over(running) + F.col(f"__s_{c}"))
    return rows.drop("__pid", "__id", "__n", *[f"__s_{c}" for c in sums])


def places(df: DataFrame, by: str, order: Sequence[str], out: str = "place") -> DataFrame:
    """Add the 1-based position in ``order`` within each value of ``by``.

    Positions are global ones less those of the values before, so a value with any share of the rows is spread over tasks. Of ``by`` one row a value is broadcast.
    """
    rows = global_running(df, [by, *order], out="__at")
    first = rows.groupBy(by).agg(F.min("__at").alias("__first"))
    return (rows.join(F.broadcast(first.withColumnRenamed(by, "__by")), F.col(by).eqNullSafe(F.col("__by")))
            .withColumn(out, F.col("__at") - F.col("__first") + 1).drop("__at", "__first", "__by"))


def _bucketed(df: DataFrame, value: str, descending: bool = False) -> tuple[DataFrame, list]:
    """Tag rows with an equal-width bucket of ``value`` and return the histogram (at most BUCKETS rows).

    Rows without a number (null or NaN) get no bucket and do not count.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return df.withColumn("__b", F.lit(None).cast("int")), []
    width = (hi - lo) / BUCKETS or 1.0
    b = F.when(v.isNotNull(), F.least(F.floor((v - lo) / width), F.lit(BUCKETS - 1)).cast("int"))
    tagged = df.withColumn("__b", -b if descending else b)
    hist = tagged.where("__b is not null").groupBy("__b").agg(F.count("*").alias("n"), F.sum(value).alias("s")).collect()
    return tagged, sorted(hist)


def _split_at(tagged: DataFrame, at: int, slice_rows: DataFrame) -> DataFrame:
    rest = tagged.where(F.col("__b").isNull() | (F.col("__b") != at)).withColumn("dropped", F.coalesce(F.col("__b") < at, F.lit(False)))
    return rest.drop("__b").unionByName(slice_rows)


def drop_min_until_mean(df: DataFrame, target: float, cap: float, value: str = "iou", name: str = "name") -> DataFrame:
    """Flag ``dropped`` on the fewest lowest rows whose removal lifts the mean of the rest to ``target``.

    Dropping stops after the row that takes the dropped share above ``cap``, so one row more than the
    cap allows can go. Ties are taken in name order. Rows without a number stay and do not count. The input is read several times: pass a stored or
    checkpointed table.
    """
    tagged, hist = _bucketed(df, value)
    n, total = sum(h["n"] for h in hist), math.fsum(h["s"] for h in hist)

    def done(k: int, s: float) -> bool:
        return k >= n or (total - s) / max(n - k, 1) >= target or k / max(n, 1) > cap
    k, s, at = 0, 0.0, None
    if not done(0, 0.0):
        for h in hist:
            if done(k + h["n"], s + h["s"]):
                at = h["__b"]
                break
            k, s = k + h["n"], s + h["s"]
    if at is None:
        return tagged.withColumn("dropped", F.lit(False)).drop("__b")
    rows = global_running(tagged.where(F.col("__b") == at), [value, name], [value])
    gone = F.col("rn") - 1 + F.lit(k)
    left = F.lit(total - s) - (F.col(f"cum_{value}") - F.col(value))
    go_on = (left / F.greatest(F.lit(n) - gone, F.lit(1)) < target) & (gone / F.lit(float(n)) <= cap)
    rows = rows.withColumn("dropped", go_on).drop("rn", f"cum_{value}", "__b")
    return _split_at(tagged, at, rows)


def drop_top_fraction(df: DataFrame, frac: float, value: str = "err_mean", name: str = "name",
                      threshold: float | None = None) -> DataFrame:
    """Flag ``dropped`` on the floor(frac*n) rows of largest ``value``, then on any above ``threshold``.

    Rows without a number (null or NaN) stay and do not count.
    The input is read several times: pass a stored or checkpointed table.
    """
    tagged, hist = _bucketed(df, value, descending=True)
    n = sum(h["n"] for h in hist)
    want = math.floor(frac * n)
    out, k = None, 0
    if want > 0:
        for h in hist:
            if k + h["n"] >= want:
                part = tagged.where(F.col("__b") == h["__b"]).withColumn("__neg", -F.col(value))
                rows = global_running(part, ["__neg", name])
                rows = rows.withColumn("dropped", F.col("rn") <= want - k).drop("rn", "__neg", "__b")
                out = _split_at(tagged, h["__b"], rows)
                break
            k += h["n"]
    if out is None:
        out = tagged.withColumn("dropped", F.lit(False)).drop("__b")
    if threshold is not None:
        number = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))
        out = out.withColumn("__v", number).withColumn("dropped", F.col("dropped") | (F.col("__v") > threshold)).drop("__v")
    return out


def lowest_k(df: DataFrame, k: int, value: str = "iou", name: str = "name") -> DataFrame:
    return df.orderBy(F.asc(value), name).limit(k)


def highest_k(df: DataFrame, k: int, value: str = "iou", name: str = "name") -> DataFrame:
    return df.orderBy(F.desc(value), name).limit(k)


def top_n_per_group(df: DataFrame, n: int, group: Sequence[str], order: Sequence[Column | str], out: str = "rn") -> DataFrame:
    """First ``n`` rows of each group; Spark limits every group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def paginate(df: DataFrame, per_page: int, cols: int, order: Sequence[str]) -> DataFrame:
    """Page number (from 1), row and column in the page grid, and the page count."""
    rows = global_running(df, order)
    total = rows.agg(F.ceil(F.count("*") / per_page).alias("n_pages"), F.lit(0).alias("__one"))
    i = F.col("rn") - 1
    slot = i % per_page
    rows = rows.withColumns({"page": F.floor(i / per_page) + 1, "grid_row": F.floor(slot / cols), "grid_col": slot % cols,
                             "__one": F.lit(0)})
    return rows.join(total, "__one").drop("__one")


def ordered_union_distinct(lists: Sequence[tuple[DataFrame, Column]], name: str = "name") -> DataFrame:
    """Union of name lists in list order, each sorted by its key; a name stays at its first place.

    The first place of a name is a minimum, so duplicates are removed by a pre-aggregated group.
    Columns: name, prio, key; order by (prio, key, name).
    """
    out = None
    for prio, (df, key) in enumerate(lists):
        part = df.select(F.col(name).alias("name"), F.lit(prio).alias("prio"), key.cast("double").alias("key"))
        out = part if out is None else out.unionByName(part)
    return (out.groupBy("name").agg(F.min(F.struct("prio", "key")).alias("p"))
            .select("name", "p.prio", "p.key").orderBy("prio", "key", "name"))


def ordered_distinct(df: DataFrame, lists: Sequence[tuple[Column, Column]], name: str = "name") -> DataFrame:
    """:func:`ordered_union_distinct` for lists that are conditions on the rows of one table, in one pass."""
    places = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(prio).alias("prio"), key.cast("double").alias("key")))
        for prio, (cond, key) in enumerate(lists)]))
    return (df.select(F.col(name).alias("name"), F.array_min(places).alias("p")).where(F.col("p").isNotNull())
            .groupBy("name").agg(F.min("p").alias("p")).select("name", "p.prio", "p.key").orderBy("prio", "key", "name"))


def rank_leaderboard(df: DataFrame) -> DataFrame:
    """Models by mean IoU, recall at 95, recall at 99 (greatest first), then p95 corner error (least first)."""
    w = Window.orderBy(F.desc("mean_iou"), F.desc("recall_95"), F.desc("recall_99"), F.asc("corner_error_p95_px"))
    return df.withColumn("rank", F.rank().over(w))


def training_events(history: DataFrame, patience: int, by: Sequence[str], value: str = "mean_iou") -> DataFrame:
    """Per epoch: running best, whether it improved (strictly), best epoch so far, epochs since, early stop.

    ``by`` names the run. One run is its epochs, a short sequence; runs are independent windows.
    """
    if not by:
        raise ValueError("name the columns that tell runs apart")
    w = Window.partitionBy(*by).orderBy("epoch")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    improved = F.col(value) > F.coalesce(F.max(value).over(prior), F.lit(0.0))
    rows = history.withColumn("improved", improved)
    rows = rows.withColumn("best_epoch", F.coalesce(
        F.last(F.when(F.col("improved"), F.col("epoch")), ignorenulls=True).over(upto), F.lit(0)))
    rows = rows.withColumn("best_value", F.max(value).over(upto))
    rows = rows.withColumn("since_best", F.col("epoch") - F.col("best_epoch"))
    stop = F.min(F.when(F.col("since_best") >= patience, F.col("epoch"))).over(Window.partitionBy(*by))
    return rows.withColumn("stop_epoch", stop)


def lr_events(history: DataFrame, lr_patience: int, warmup: int, lr: float = 1.0, factor: float = 0.5,
              min_lr: float = 0.0, *, by: Sequence[str], value: str = "mean_iou") -> DataFrame:
    """Epochs at which the learning rate is cut (``lr_cut``) and the rate after each epoch (``lr``).

    A cut comes each time ``lr_patience`` epochs pass without a new best. The counter restarts at a new
    best and at a cut, so cuts fall at multiples of the patience after a best; before the warm-up ends it
    only counts, and the first cut comes at the end of warm-up. No cut is made once ``min_lr`` is reached.
    """
    rows = training_events(history, lr_patience, by, value)
    # with s epochs since the best, the first possible cut is at max(patience, warmup + 1 - best)
    first = F.greatest(F.lit(lr_patience), F.lit(warmup + 1) - F.col("best_epoch"))
    s = F.col("since_best")
    rows = rows.withColumn("__due", (s >= first) & ((s - first) % lr_patience == 0))
    w = Window.partitionBy(*by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("__due").cast("int")).over(w)
    rate = F.pow(F.lit(factor), n) * F.lit(lr)
    cut_now = F.col("__due") & (F.pow(F.lit(factor), n - 1) * F.lit(lr) > min_lr)
    return (rows.withColumns({"lr_cut": cut_now, "lr": F.greatest(rate, F.lit(min_lr))}).drop("stop_epoch", "__due"))


def outlier_review_order() -> list[Column]:
    """Weird first, then border, then small; inside, least margin, then least area, then name."""
    prio = F.when(F.col("weird"), 0).when(F.col("near_border"), 1).otherwise(2)
    return [prio, F.col("border_margin_norm"), F.col("area_ratio"), F.col("name")]


def candidate_order() -> list[Column]:
    return [F.asc("iou"), (F.col("detected") != 0).cast("int"), F.asc("name")]


BANDS = {"failed": (None, 0.5), "low_iou": (0.5, 0.75), "medium_iou": (0.75, 0.9), "high_iou": (0.9, 0.95),
         "excellent": (0.95, None)}


def review_filter(kind: str, acute_deg: float = 60.0) -> Column:
    live = ~F.col("is_negative") & ~F.col("discarded")
    if kind == "all":
        return live
    if kind in BANDS:
        lo, hi = BANDS[kind]
        c = live
        if lo is not None:
            c = c & (F.col("iou") >= lo)
        return c & (F.col("iou") < hi) if hi is not None else c
    if kind == "acute_gt":
        return live & (F.col("gt_min_angle") < acute_deg)
    if kind == "high_error":
        return live & (F.col("err_mean") > 10)
    if kind == "modified":
        return F.col("modified") & ~F.col("discarded")
    if kind == "discarded":
        return F.col("discarded")
    if kind == "negative":
        return F.col("is_negative") & ~F.col("discarded")
    if kind in ("train", "val"):
        return F.col("split") == kind
    return F.lit(True)


SORTS = {"error_desc": ("err_mean", True), "error_asc": ("err_mean", False), "iou_asc": ("iou", False),
         "iou_desc": ("iou", True), "gt_angle_asc": ("gt_min_angle", False), "gt_angle_desc": ("gt_min_angle", True),
         "name": ("name", False)}


def review_queue(df: DataFrame, kind: str = "all", sort: str = "iou_asc", acute_deg: float = 60.0) -> DataFrame:
    col, desc = SORTS[sort]
    return df.where(review_filter(kind, acute_deg)).orderBy(F.desc(col) if desc else F.asc(col), "name")


def queue_places(df: DataFrame, sorts: dict[str, str], acute_deg: float = 60.0, digits: int | None = None) -> DataFrame:
    """``kind, name, place``: where each row stands in the queue of every filter it passes, each filter under its own sort.

    ``digits`` rounds the sort keys, so that values equal to so many decimals go by name; filters see the values as they are. All queues are one table (at most one row per row and filter), placed in one pass.
    """
    def entry(kind: str) -> Column:
        col, desc = SORTS[sorts[kind]]
        key = F.lit(0.0) if col == "name" else F.col(col).cast("double")
        key = key if digits is None else F.round(key, digits)
        # ascending: missing ones first; descending: last
        missing = key.isNull() if desc else key.isNotNull()
        return F.when(review_filter(kind, acute_deg), F.struct(F.lit(kind).alias("kind"), missing.alias("__late"), (-key if desc else key).alias("__key")))
    rows = df.select("name", F.explode(F.array_compact(F.array(*map(entry, sorts)))).alias("q")).select("name", "q.*")
    return places(rows, "kind", ["__late", "__key", "name"]).select("kind", "name", "place")


def limit_first(df: DataFrame, n: int, order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    if not by:
        return df.orderBy(order).limit(n)
    return top_n_per_group(df, n, by, [order])
