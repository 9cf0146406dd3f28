"""Running a user's predictor or image decoder on executors."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

Predictor = Callable[[pd.DataFrame], pd.DataFrame]
Decoder = Callable[[Sequence[bytes]], Sequence[Sequence[float]]]

#: Predictors that a worker process keeps, most recently used last.
KEPT = 2
_loaded: OrderedDict[str, Predictor] = OrderedDict()


def loaded(key: str, factory: Callable[[], Predictor]) -> Predictor:
    """The predictor of ``factory``, built once per worker process and key; the least recently used of more than KEPT goes."""
    if key not in _loaded:
        _loaded[key] = factory()
        while len(_loaded) > KEPT:
            _loaded.popitem(last=False)
    _loaded.move_to_end(key)
    return _loaded[key]


def score(df: DataFrame, factory: Callable[[], Predictor], schema: str | StructType) -> DataFrame:
    """Call the predictor on each Arrow batch; it is built once per worker process, not per task.

    ``schema`` is the output schema; the predictor returns one frame per batch. Factories are told apart by their code and what they hold. A worker that is lost
    or not reused (``spark.python.worker.reuse``) builds its predictor anew.
    """
    key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quadlab.operators import scoring  # the module of the process, not a copy that came with this function
        predict = scoring.loaded(key, factory)
        for batch in batches:
            yield predict(batch)
    return df.mapInPandas(run, schema)


def _decoded(decode: Decoder, contents: list[bytes]) -> list:
    """What ``decode`` makes of the contents, None for each that it can't open: a part with a broken content is halved until that stands alone."""
    try:
        out = list(decode(contents))
        if len(out) != len(contents):
            raise ValueError("the decoder must answer for every content")
        return out
    except Exception:
        if len(contents) == 1:
            return [None]
        half = len(contents) // 2
        return _decoded(decode, contents[:half]) + _decoded(decode, contents[half:])


def decode_images(files: DataFrame, decode: Decoder, out: str = "grid", most_bytes: int = 64 << 20) -> DataFrame:
    """Apply a user's decoder to the ``content`` of binary files: ``out`` and ``status`` (``ok`` or ``failed_open_image``) in its place.

    The decoder gets lists of contents of up to ``most_bytes`` together (a larger one alone). A content that it can't open, or that is null, is a row with that status, and the job goes on. Other columns pass
    through. How many contents reach a task at once is up to ``spark.sql.execution.arrow.maxRecordsPerBatch``: set it low for large files.
    """
    others = [f for f in files.schema if f.name != "content"]
    if {"status", out} & {f.name for f in others}:
        raise ValueError(f"columns named status or {out} would be overwritten")
    schema = StructType(list(others)).add(out, ArrayType(DoubleType())).add("status", StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = batch["content"].tolist()
            grids: list = [None] * len(contents)
            part, held = [], 0
            for i, c in enumerate([*contents, None]):
                size = 0 if c is None else len(c)
                if part and (i == len(contents) or held + size > most_bytes):
                    for j, g in zip(part, _decoded(decode, [contents[j] for j in part])):
                        grids[j] = g
                    part, held = [], 0
                if c is not None:
                    part.append(i)
                    held += size
            done = batch.drop(columns="content")
            done[out] = grids
            done["status"] = ["failed_open_image" if g is None else "ok" for g in grids]
            yield done
    return files.select(*[F.col(f.name) for f in others], "content").mapInPandas(run, schema)


def pseudo_labels(scored: DataFrame, threshold: float, order: Callable[[Column], Column]) -> DataFrame:
    """Prediction rows from scored samples: negatives, failures and scores below the threshold are undetected."""
    hit = (~F.col("is_negative")) & F.col("coords").isNotNull() & (F.col("score") >= threshold)
    return scored.select(
        "split", "name", F.coalesce(hit, F.lit(False)).cast("int").alias("detected"),
        F.when(hit, F.col("score")).otherwise(F.lit(0.0)).alias("conf"),
        F.when(hit, order(F.col("coords"))).otherwise(F.array_repeat(F.lit(-1.0), 8)).alias("coords"))
