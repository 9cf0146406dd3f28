"""Quality scores of texts by an additive model of their shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quadlab.llm import additive_model
from quadlab.llm.common import written
from quadlab.llm.labelled import SAMPLE, remainder, sample
from quadlab.llm.shingles import WordHashes
from quadlab.llm.text_stats import features


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the features of each whole text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        with np.errstate(over="ignore"):
            for pdf in batches:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [features(t, cache) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, x array<double>").withColumn("doc_id", F.col("doc_id").cast("long"))


def fitted(rows: DataFrame, labels: DataFrame, label: str, usable: Column, most: int = SAMPLE) -> additive_model.AdditiveModel:
    got = sample(rows, labels, label, usable, most).select("doc_id", "x", "y").toPandas().sort_values("doc_id", kind="stable")
    return additive_model.fit(np.array(got["x"].tolist()), got["y"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, most: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    The model is fitted on at most ``most`` labelled rows whose id's crc32 modulo ``folds`` is not ``held``; it reads shapes of whole texts only.
    Null texts count as empty and are scored; a row without an id is not held out; without any labels every score is 0.5; an empty table gives no rows.
    """
    rows = written(feature_table(docs))
    model = fitted(rows, labels, "quality", remainder(folds) != held, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["x"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": model.score(x)})

    out = rows.withColumn("held_out", F.coalesce(remainder(folds) == held, F.lit(False))).select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "x")
    return out.mapInPandas(run, "doc_id string, held_out boolean, score double").select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
