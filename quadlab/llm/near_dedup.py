"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quadlab.llm.common import cut, fresh, written
from quadlab.llm.components import connected_components
from quadlab.llm.set_links import components_of_alike
from quadlab.llm.shingles import WordHashes, minhashes, mixed, permutations, shingle_hashes

#: Signature: this many symbols of 16 bits, cut into this many chunks; pairs that differ in up to DISTANCE symbols have,
#: by the pigeonhole principle, a chunk with at most DISTANCE // CHUNKS errors.
SYMBOLS, CHUNKS, DISTANCE, SEED = 32, 8, 15, 71


def _sets(texts, size: int, cache: WordHashes) -> Iterator[np.ndarray]:
    for t in texts:
        h = cache.of(t.encode().lower().split()) if t else np.empty(0, dtype=np.uint64)
        yield np.unique(shingle_hashes(h, size))


def signatures(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, n_shingles, set_id, keys`` of each row: set size, digest of the set, and the probe keys.

    Words are lower-cased (A-Z) and cut at ASCII white space. A probe key is a chunk of the signature with one symbol left
    out (the enumerated error) together with the chunk's number and the left-out place. Null or empty texts have an empty set and no keys.
    """
    per = SYMBOLS // CHUNKS
    errors = DISTANCE // CHUNKS
    if errors != 1 or SYMBOLS % CHUNKS:
        raise ValueError("probe keys enumerate exactly one error per chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, (a, b) = WordHashes(), permutations(SYMBOLS, SEED)
        place = np.arange(SYMBOLS, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for pdf in batches:
                n, ids, keys = [], [], []
                for s in _sets(pdf["text"], size, cache):
                    n.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                    if not len(s):
                        keys.append(np.empty(0, dtype=np.int64))
                        continue
                    sig = mixed(minhashes(s, a, b)) & np.uint64(0xFFFF)
                    whole = (sig + np.uint64(1)) << (np.uint64(16) * (place % np.uint64(per)) % np.uint64(64))
                    whole = mixed(whole + place * np.uint64(0x9E3779B97F4A7C15)).reshape(CHUNKS, per)
                    left_out = whole.sum(axis=1, keepdims=True, dtype=np.uint64) - whole
                    keys.append(mixed(left_out + place.reshape(CHUNKS, per)).ravel().view(np.int64))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "set_id": ids, "keys": keys})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "doc_id long, n_shingles long, set_id string, keys array<long>")


def shingle_sets(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, shingles``: the whole set of each row as sorted hashes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        with np.errstate(over="ignore"):
            for pdf in batches:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "shingles": [s.view(np.int64) for s in _sets(pdf["text"], size, cache)]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, shingles array<long>")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Equal sets are one class, named by its smallest ``doc_id``. Class representatives that share a probe key are candidates; all signature pairs
    within ``DISTANCE`` symbols share one. ``components_of_alike`` compares them on full sets and gives the components of all links.

    A null or empty text has set size 0, is its own component and kept. A row without ``doc_id`` is scored, has a null
    component and is kept. Rows that repeat a ``doc_id`` are one document. An empty table gives no rows.
    """
    sigs = written(signatures(docs, size))
    classes = (sigs.where("set_id is not null and doc_id is not null").groupBy("set_id")
               .agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")))
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = classes.select("rep", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high").select("key")
    buckets = written(keyed.join(shared, "key").select("key", F.col("rep").alias("id")).distinct())
    sets = written(shingle_sets(known.join(buckets.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), size))
    parts = components_of_alike(buckets, sets.withColumnRenamed("doc_id", "id"), percent)
    # rows that repeat a doc_id tie their classes together
    names = sigs.where("doc_id is not null and set_id is not null").select("doc_id", "set_id").distinct().join(
        classes.select("set_id", "rep"), "set_id").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    twice = sigs.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x != y").select(F.col("doc_id").alias("a"))
    if twice.take(1):
        tied = names.join(twice, "a", "left_semi").select("a", "b")
        parts = cut(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(tied)))
    to = classes.select("set_id", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_id", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "set_id").join(to, "set_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest ``doc_id``; all columns. Rows without ``doc_id`` stay; of rows that share one, the first by text stays."""
    d, n = fresh(docs.columns, "__d"), fresh(docs.columns, "__n")
    gone = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias(d)).distinct()
    rows = docs.join(gone, F.col("doc_id").cast("long") == F.col(d), "left_anti")
    known = rows.where("doc_id is not null").withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(n) == 1)
    return known.select(*docs.columns).unionByName(rows.where("doc_id is null").select(*docs.columns))
