"""Lines that many sites share, found by HyperLogLog sketches of the sites of each line."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quadlab.llm.common import fresh, written

#: A line on this many sites is boilerplate. Sketches have 2**LG_K registers.
MIN_SITES, LG_K = 6, 12


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a text, with what names them: doc_id may be missing or repeat."""
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__h"),
                                                 F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), "text")


def site_lines(docs: DataFrame) -> DataFrame:
    r"""``doc_id, __h, site, pos, k1, k2`` of every \n-split line with a word; the keys hash the line without outer white space."""
    line = F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return (_keyed(docs).select("doc_id", "__h", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .select("doc_id", "__h", "site", "pos", line.alias("line")).where("line != ''")
            .select("doc_id", "__h", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``k1, k2, doc, pos`` of each line on at least ``min_sites`` distinct sites, and its first place.

    Sketches of the sites are merged per line, partly before the shuffle; an estimate beyond four standard errors (one site at least) of the threshold decides,
    lines nearer to it get an exact distinct count.
    """
    sketched = lines.groupBy("k1", "k2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h", "pos")).alias("first"))
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(2**LG_K) * min_sites))
    likely = written(sketched.where(F.col("sites") >= min_sites - margin))
    sure = likely.where(F.col("sites") > min_sites + margin)
    near = likely.where(F.col("sites") <= min_sites + margin)
    exact = (lines.join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "site").distinct()
             .groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites))
    return sure.select("k1", "k2", "first").unionByName(near.join(exact.select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Every row of ``docs`` with boilerplate lines cut from ``text``, and the number cut in a new last column ``n_removed``.

    A site is a ``source``; rows without one share a site. Of each boilerplate line the first occurrence in the table (by
    ``doc_id``, then text, then place) stays, so that a text copied to many sites is not lost. Blank lines are never cut; a null text stays null;
    a repeated row is treated as its twin; other columns pass through. All lines are counted on their whole length.
    """
    if "n_removed" in {c.lower() for c in docs.columns}:
        raise ValueError("column n_removed is taken")
    lines = written(site_lines(docs))
    spread = written(spread_lines(lines, min_sites))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h", "pos")
    d, t, cut, h = (fresh(docs.columns, x) for x in ("__d", "__t", "__cut", "__h"))
    gone = (lines.join(spread, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "__h", "pos").distinct()
            .groupBy("doc_id", "__h").agg(F.collect_list("pos").alias(cut))
            .select(F.col("doc_id").alias(d), F.col("__h").alias(t), cut))
    both = docs.withColumn(h, F.xxhash64("text")).join(
        gone, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.filter(numbered, lambda s: ~F.array_contains(cut, s["i"]))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    others = [F.col(c) if c.lower() != "text" else text.alias(c) for c in docs.columns]
    return both.select(*others, F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).alias("n_removed"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines; all columns, ``n_chars`` counted anew where lines went. Rows that lose all their words go."""
    out = remove_boilerplate(docs, min_sites)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
