"""Passages of a benchmark in training texts, found by spaced seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadlab.llm.common import fresh

#: Fixed masks; a 0 ignores the token at its place, so that a substitution there does not hide the match.
MASKS = ("11101001011", "11010110011", "11001110101")
#: With this one too, a lone window of 13 tokens has a seed for every two differing places, one of 12 tokens for every one.
MASKS_MORE = ("10011011110",)
#: An overlap is WINDOW aligned tokens around a seed, of which at most ERRORS differ.
WINDOW, ERRORS = 13, 2
#: Longs of the bitmap of benchmark seeds: a fixed size, whatever the tables.
BITMAP = 1 << 16

_SPAN = len(MASKS[0])
_SIDE = WINDOW - _SPAN


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _short_masks(n: int) -> tuple[str, ...]:
    """Masks of a whole item of n tokens, fewer than ``WINDOW``: every ``ERRORS`` places of 11 or 12 tokens are ignored by one; below, no difference is allowed."""
    if n < _SPAN:
        return ("1" * n,)
    return tuple("".join("0" if i // 3 in (a, b) else "1" for i in range(n)) for a in range(4) for b in range(a + 1, 4))


def _windows(df: DataFrame, keep: list[str], text: str, pad: int, masks: tuple[str, ...] = MASKS + MASKS_MORE, side: int = _SIDE, over: int = 0) -> DataFrame:
    """One row per window of a text: where it starts, its hashed tokens ``t`` (padded on both sides), its seeds, and the tokens ``around`` it.

    Windows reach ``over`` tokens beyond the text.

    The partition ids, which a later filter reads, keep that filter and those the optimizer infers above the tokens and seeds; below, they would compute them again.
    """
    pads, span = side + over, len(masks[0])
    edge = F.array(*[F.lit(pad).cast("long")] * pads).cast("array<bigint>")
    hashed = F.concat(edge, F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w)), edge)
    rows = df.select(*keep, hashed.alias("t"), F.spark_partition_id().alias("p0"))
    n = F.size("t") - 2 * pads
    at = F.when(n + 2 * over >= span, F.sequence(F.lit(-over), n - span + over))
    seeds = [_seed(m, mask, pads).alias(f"s{m}") for m, mask in enumerate(masks)]
    around = F.slice("t", F.col("at") + over + 1, span + 2 * side)
    return (rows.select(*keep, "t", "p0", n.alias("n"), F.explode(at).alias("at"))
            .select("*", *seeds, around.alias("around"), F.spark_partition_id().alias("p1")))


def _seed(m: int, mask: str, pads: int) -> Column:
    return F.xxhash64(F.lit(m), *[F.get("t", F.col("at") + pads + i) for i, c in enumerate(mask) if c == "1"])


def _probes(seed: Column) -> list[tuple[Column, Column]]:
    """Word and bit of both probes of a seed."""
    return [(F.shiftrightunsigned(seed, s).bitwiseAND(F.lit(BITMAP - 1)).cast("int"), F.shiftrightunsigned(seed, b).bitwiseAND(F.lit(63)).cast("int"))
            for s, b in ((0, 16), (32, 48))]


def _bitmap(seeds: DataFrame) -> DataFrame:
    """One row with the seeds' bits in ``BITMAP`` longs."""
    spark = seeds.sparkSession
    probe = F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _probes(F.col("seed"))])
    bits = (seeds.select(F.explode(probe).alias("p")).select("p.word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.bit")).alias("b"))
            .groupBy("word").agg(F.bit_or("b").alias("b")))
    every = spark.range(BITMAP).select(F.col("id").cast("int").alias("word")).join(bits, "word", "left")
    row = F.sort_array(F.collect_list(F.struct("word", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return every.agg(F.transform(row, lambda s: s["b"]).alias("bits"))


def overlaps(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """``doc_id, text_hash, item_id, matched``: documents and benchmark items that overlap, and the most equal tokens of a window.

    Seeds (tokens under a mask) of both sides are joined on their hash; around each hit the aligned windows of ``WINDOW`` tokens that
    hold it are compared token by token, and one with at most ``ERRORS`` differences (within the item, if that is
    shorter) counts. Document windows first pass a bitmap of all benchmark seeds, a filter of fixed size without false negatives, so that the
    join shuffles few of them. The masks meet every such window of ``WINDOW`` tokens. Those of items of eleven and twelve tokens they meet in part, and
    items and documents of fewer than eleven tokens hold no seed; with ``short_items``, each length of items below ``WINDOW`` is looked for
    with masks of its own: eleven and twelve tokens with up to ``ERRORS`` differences, wherever these are, fewer tokens word for word.
    Null texts have no tokens and items without tokens never match; repeated rows count once;
    a missing ``doc_id`` stays null. Columns other than ``doc_id, text`` and ``item_id, text`` are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = _overlaps(rows, items, MASKS + MASKS_MORE, _SIDE, 0, WINDOW, F.least(F.lit(WINDOW), F.col("n")) - ERRORS)
    if short_items:
        n = F.size(tokens(F.col("text")))
        for r in items.select(n.alias("n")).where(f"n between 1 and {WINDOW - 1}").distinct().collect():
            errors = ERRORS if r["n"] >= _SPAN else 0
            out = out.unionByName(_overlaps(rows, items.where(n == r["n"]), _short_masks(r["n"]), 0, errors, r["n"], F.lit(r["n"] - errors)))
    return out.groupBy("doc_id", "text_hash", "item_id").agg(F.max("matched").alias("matched"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], side: int, over: int, window: int, least: Column) -> DataFrame:
    marks = range(len(masks))
    seeds = F.explode(F.array(*[f"s{m}" for m in marks])).alias("seed")
    items = (_windows(benchmark, ["item_id"], "text", -1, masks, side)
             .where("p0 + p1 >= 0").select("item_id", "n", F.col("around").alias("there"), seeds).distinct())
    bits = _bitmap(items).scalar()

    def maybe(seed: Column) -> Column:
        hit = [F.call_function("getbit", F.get(bits, w), b) == 1 for w, b in _probes(seed)]
        return hit[0] & hit[1]

    found = _windows(docs, ["doc_id", "text_hash"], "text", -2, masks, side, over)
    some = maybe(F.col("s0"))
    for m in marks[1:]:
        some = some | maybe(F.col(f"s{m}"))
    found = found.where((F.col("p0") + F.col("p1") >= 0) & some).select("doc_id", "text_hash", F.col("around").alias("here"), seeds)
    same = F.zip_with("here", "there", lambda a, b: (a == b).cast("int"))
    scores = [F.aggregate(F.slice("same", s + 1, window), F.lit(0), lambda a, x: a + x) for s in range(side + 1)]
    return (found.join(items, "seed").withColumn("same", same).withColumn("matched", F.greatest(*scores) if side else scores[0])
            .where(F.col("matched") >= least).groupBy("doc_id", "text_hash", "item_id").agg(F.max("matched").alias("matched")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """Rows of ``docs`` that overlap with no benchmark item (see ``overlaps``); all columns."""
    d, t, h = (fresh(docs.columns, x) for x in ("__d", "__t", "__h"))
    bad = overlaps(docs, benchmark, short_items).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct()
    rows = docs.withColumn(h, F.xxhash64("text"))
    return rows.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left_anti").select(*docs.columns)
