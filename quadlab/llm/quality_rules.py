"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quadlab.llm.common import fresh, written
from quadlab.llm.shingles import WordHashes
from quadlab.llm.text_stats import FEATURES, base_counts, features

#: Each rule reads one number of a text: votes for quality inside ``good``, against it inside ``bad``, else abstains.
RULES: tuple[tuple[str, tuple[float, float], tuple[float, float]], ...] = (
    ("log_words", (4.6, 99), (0, 3.0)),
    ("mean_word", (3, 9), (12, 1e9)),
    ("symbols", (0, 0.02), (0.1, 1e9)),
    ("dup_lines", (0, 0.1), (0.3, 1)),
    ("repeats", (0, 0.15), (0.3, 1)),
    ("upper", (0, 0.1), (0.3, 1)),
    ("alpha", (0.7, 1), (0, 0.5)),
    ("common", (0.06, 1), (0, 0.01)),
    ("ends", (0.01, 0.4), (0, 0.003)),
    ("bars", (0, 0.02), (0.1, 1e9)),
    ("exclaims", (0, 0.05), (0.2, 1e9)),
    ("distinct", (0.3, 1), (0, 0.15)),
)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RULED = "".join(f"{n} long, " for n in _COUNTS) + "votes binary"


def _ruled(texts: pd.Series, cache: WordHashes) -> pd.DataFrame:
    """The base counts and ``votes`` (1 for, -1 against, 0 abstains; one byte per rule) of each text."""
    at = [FEATURES.index(name) for name, _, _ in RULES]
    good, bad = np.array([g for _, g, _ in RULES]), np.array([b for _, _, b in RULES])
    with np.errstate(over="ignore"):
        counts = [base_counts(t, cache) for t in texts]
        x = np.array([features(t, cache, c) for t, c in zip(texts, counts)]).reshape(len(texts), -1)[:, at]
    votes = ((x >= good[:, 0]) & (x <= good[:, 1])).astype(np.int8) - ((x >= bad[:, 0]) & (x <= bad[:, 1])).astype(np.int8)
    return pd.DataFrame({k: [c[k] for c in counts] for k in _COUNTS} | {"votes": [bytes(v.astype(np.uint8).tolist()) for v in votes]})


def rule_table(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash``, the base counts and ``votes`` of each row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for pdf in batches:
            yield pd.concat([pdf[["doc_id", "text_hash"]], _ruled(pdf["text"], cache)], axis=1)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(
        run, f"doc_id string, text_hash long, {_RULED}").withColumn("doc_id", F.col("doc_id").cast("long"))


def accuracies(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good texts, and each rule's chance of voting right on good and on bad texts, from distinct vote patterns.

    Abstaining says nothing. Good texts pass a rule more often than not; a bad text need not break every rule, but a vote
    against never speaks for a text. The share stays within 0.05 and 0.95.
    """
    share, right = 0.8, np.tile([0.95, 0.5], (votes.shape[1], 1))
    for _ in range(rounds):
        for_, against = votes == 1, votes == -1
        score = (np.log(share / (1 - share)) + for_ @ np.log(right[:, 0] / (1 - right[:, 1])) + against @ np.log((1 - right[:, 0]) / right[:, 1]))
        p = 1 / (1 + np.exp(-score))
        w1, w0 = counts * p, counts * (1 - p)
        new = np.stack([(w1 @ for_ + 4) / (w1 @ (for_ | against) + 5), (w0 @ against + 4) / (w0 @ (for_ | against) + 5)], axis=1)
        new[:, 0] = np.clip(new[:, 0], 0.5, 0.999)
        new[:, 1] = np.clip(np.maximum(new[:, 1], 1 - new[:, 0]), 0.001, 0.999)
        share_ = float(np.clip(w1.sum() / counts.sum(), 0.05, 0.95))
        done = np.abs(new - right).max() < 1e-9 and abs(share - share_) < 1e-9
        share, right = share_, new
        if done:
            break
    return share, right


def _quality(rows: DataFrame, votes: Column) -> Column:
    """The posterior chance that a text is good, from its votes and the accuracies estimated on all rows; the driver sees the counts of distinct vote patterns only."""
    patterns = rows.groupBy(votes.alias("votes")).agg(F.count("*").alias("n")).collect()
    patterns.sort(key=lambda r: bytes(r["votes"]))
    if patterns:
        table = np.array([np.frombuffer(bytes(r["votes"]), dtype=np.int8) for r in patterns])
        share, right = accuracies(table, np.array([float(r["n"]) for r in patterns]))
    else:
        share, right = 0.5, np.full((len(RULES), 2), 0.8)
    hexed = F.hex(votes)

    def weight(i: int) -> Column:
        vote = F.substring(hexed, 2 * i + 1, 2)
        return (F.when(vote == "01", float(np.log(right[i, 0] / (1 - right[i, 1])))).when(vote == "FF", float(np.log((1 - right[i, 0]) / right[i, 1]))).otherwise(0.0))

    score = reduce(Column.__add__, [weight(i) for i in range(len(RULES))], F.lit(float(np.log(share / (1 - share)))))
    return 1 / (1 + F.exp(-score))


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept`` of each row of ``docs``.

    ``quality`` is the posterior chance that a text is good, from the votes of all rules and accuracies estimated on
    all rows; the driver sees the counts of distinct vote patterns only. Kept are texts that pass the base rules and
    have ``quality`` of 0.5 or more. A null or empty text has zero counts and fails; repeated rows are judged alike; an empty table gives no rows.
    """
    rows = written(rule_table(docs))
    return (rows.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn("quality", _quality(rows, F.col("votes")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("votes"))


def good_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, as ``judged`` says; all columns. Rows are written with their votes, so that verdicts need no join with the texts."""
    @F.pandas_udf(_RULED)
    def ruled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for texts in batches:
            yield _ruled(texts, cache)

    r = fresh(docs.columns, "__r")
    rows = written(docs.withColumn(r, ruled("text")))
    failed = _failed(F.col(f"{r}.n_words"), F.col(f"{r}.n_repeat_words"))
    return rows.where(~failed & (_quality(rows, F.col(f"{r}.votes")) >= 0.5)).select(*docs.columns)
