"""Toxicity by multiple-instance learning: sentences are scored, a document is toxic if any sentence is (noisy-or)."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quadlab.llm.labelled import remainder, sample

#: At most this many labelled documents are fitted on (those with the smallest hash of their id); all documents are scored.
SAMPLE = 8_000
#: Features kept, by how far their documents' labels are from chance; how many sampled documents a feature must occur in; hash range.
KEPT, LEAST, RANGE = 4096, 5, 1 << 20
#: Word beginnings of these lengths are features besides the whole word, for languages that build words.
BEGINNINGS = (4, 5, 6, 7, 8)

_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and distinct lower-cased words of each sentence with a word; sentences end at . ! ? or a line break."""
    for m in _SENTENCE.finditer(text or ""):
        found = sorted(set(_TOKEN.findall(m[0].lower())))
        if found:
            yield m.start(), m.end(), found


class WordFeatures(dict):
    """Hashed features of a word: itself and its beginnings. Forgets all once it holds too many words."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 1_000_000:
            self.clear()
        parts = [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]
        out = self[word] = [zlib.crc32(x.encode()) % RANGE for x in parts]
        return out


class WordScores(dict):
    """Sum of the weights of a word's features, remembered."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights, self.features = weights, WordFeatures()

    def __missing__(self, word: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        get = self.weights.get
        out = self[word] = math.fsum(get(i, 0.0) for i in self.features.__missing__(word))
        self.features.clear()
        return out


class SentenceModel:
    """Log-odds of a sentence: a bias and the weights of the features of its distinct words."""

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights = bias, weights

    def document(self, text: str | None, scores: WordScores, from_: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of all sentences, and the sentences at or above a chance. 0 without sentences."""
        get, log_none, worst = scores.__getitem__, 0.0, []
        for start, end, found in sentences(text):
            z = min(max(self.bias + sum(map(get, found)), -30.0), 30.0)
            log_none -= math.log1p(math.exp(z))
            if (p := 1 / (1 + math.exp(-z))) >= from_:
                worst.append((start, end, p))
        return -math.expm1(log_none), worst


def encoded(text: str | None, features: WordFeatures) -> tuple[bytes, bytes]:
    """Features of a text's sentences one after the other, and how many each sentence has (32-bit numbers)."""
    ids, counts = [], []
    for _, _, found in sentences(text):
        before = len(ids)
        for w in found:
            ids += features[w]
        counts.append(len(ids) - before)
    return np.array(ids, dtype="<i4").tobytes(), np.array(counts, dtype="<i4").tobytes()


def fit(docs: list[tuple[bytes, bytes]], y: np.ndarray, rounds: int = 250, rate: float = 0.08, shrink: float = 5e-5) -> SentenceModel:
    """Maximise the likelihood of document labels under the noisy-or, by gradient steps on features and bias.

    ``docs`` are encoded texts. Features are screened first by the z-score of their documents' labels.
    """
    n = len(docs)
    if not n:
        return SentenceModel(0.0, {})
    y = np.asarray(y)
    if y.min() == y.max():
        return SentenceModel(30.0 if y[0] else -30.0, {})
    all_ids = [np.frombuffer(i, "<i4") for i, _ in docs]
    seen, hit = np.zeros(RANGE), np.zeros(RANGE)
    for i, label in zip(all_ids, y):
        u = np.unique(i)
        seen[u] += 1
        hit[u] += label
    share = y.mean()
    z = np.where(seen >= LEAST, np.abs(hit - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share)), 0)
    chosen = np.lexsort((np.arange(RANGE), -z))[:KEPT]
    chosen = chosen[z[chosen] > 0]
    place = np.full(RANGE, -1)
    place[chosen] = np.arange(len(chosen))
    ids, starts, owner, at, plain = [], [], [], 0, np.zeros(n)
    for d, (i, (_, c)) in enumerate(zip(all_ids, docs)):
        k = place[i]
        sent = np.repeat(np.arange(len(c) // 4), np.frombuffer(c, "<i4"))[k >= 0]
        k = k[k >= 0]
        first = np.flatnonzero(np.diff(sent, prepend=-1))
        plain[d] = len(c) // 4 - len(first)
        ids.append(k)
        starts.append(first + at)
        owner.append(np.full(len(first), d))
        at += len(k)
    ids, starts, owner = map(np.concatenate, (ids, starts, owner))
    if not len(ids):
        return SentenceModel(float(np.log(share / (1 - share))), {})
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    w, bias = np.zeros(len(chosen)), -6.0
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        s = np.clip(bias + np.add.reduceat(w[ids], starts), -30, 30)
        none = -np.bincount(owner, np.logaddexp(0, s), n) - plain * np.logaddexp(0, bias)
        p = np.clip(-np.expm1(none), 1e-9, 1)
        push = np.where(y == 1, (1 - p) / p, -1.0)  # slope of the log-likelihood by the sum of -log(1 - p_s)
        gs = push[owner] / (1 + np.exp(-s))
        gw = np.bincount(ids, gs[of], len(w)) / n - shrink * w
        gb = (gs.sum() + (push * plain).sum() / (1 + np.exp(-bias))) / n
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw**2
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb**2
        fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w += rate * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-6)
        bias += rate * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-6)
    return SentenceModel(float(bias), {int(i): float(x) for i, x in zip(chosen, w) if x})


def fitted(docs: DataFrame, labels: DataFrame, usable: Column, most: int = SAMPLE) -> SentenceModel:
    """Fit on at most ``most`` labelled documents; hashed features of their whole texts come to the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = WordFeatures()
        for pdf in batches:
            got = [encoded(t, features) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "i": [i for i, _ in got], "c": [c for _, c in got]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = sample(rows, labels, "toxic", usable, most).mapInPandas(run, "doc_id long, y int, i binary, c binary").toPandas()
    got = got.sort_values(["doc_id", "i"], kind="stable")
    return fit(list(zip(map(bytes, got["i"]), map(bytes, got["c"]))), got["y"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, sentences`` of each row; ``sentences`` are the offending ones: start, end, chance.

    The model is fitted on at most ``most`` labelled rows whose id's crc32 modulo ``folds`` is not ``held``, and reads whole texts only. A null or empty
    text scores 0; a row without an id is not held out; without labels every sentence has chance 0.5; an empty table gives no rows.
    """
    model = fitted(docs, labels, remainder(folds) != held, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(model.weights)
        for pdf in batches:
            got = [model.document(t, scores) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": [s for s, _ in got],
                                "sentences": [[{"start": a, "end": b, "chance": p} for a, b, p in w] for _, w in got]})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(remainder(folds) == held, F.lit(False)).alias("held_out"), "text")
    return out.mapInPandas(run, "doc_id string, held_out boolean, score double, sentences array<struct<start:int,end:int,chance:double>>").select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
