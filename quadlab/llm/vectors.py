"""Vectors as exact integers: which rows count, components times 256 rounded down, and sums that cannot overflow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Components below this fit the 64-bit sums of a batch; larger ones are counted with Python's integers.
SMALL = 2**26
SCALE = 256


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds neither nulls nor NaN nor infinities, with ``__x`` (array of doubles)."""
    infinite = F.lit(float("inf"))
    sound = F.forall("__x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return rows.withColumn("__x", F.col(vector).cast("array<double>")).where(F.col("__x").isNotNull() & sound)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), exactly: 64-bit integers when all are below SMALL, else Python's."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if not y.size or (np.abs(y) < SMALL).all():
        return y.astype(np.int64)
    # a double of 2^53 or more is a whole number already
    return np.array([int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in x.ravel()], dtype=object).reshape(x.shape)


def compact(x: np.ndarray) -> np.ndarray:
    """64-bit integers if all components are below SMALL."""
    return x.astype(np.int64) if all(abs(v) < SMALL for v in x.ravel().tolist()) else x.astype(object)


def batch_vectors(batch: pa.RecordBatch, dim: int, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def plain_nearest(q: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance by comparing all, in Python's integers; ties go to the lower index."""
    d = ((q.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
    at = np.array([min(range(len(entries)), key=r.__getitem__) for r in d], dtype=np.int64)
    return at, d[np.arange(len(q)), at]


class Sums:
    """Counts and componentwise sums by slot, in Python's integers."""

    def __init__(self) -> None:
        self.n: dict[int, int] = {}
        self.total: dict[int, np.ndarray] = {}

    def add(self, slots: np.ndarray, q: np.ndarray) -> None:
        if not len(slots):
            return
        order = slots.argsort(kind="stable")
        present, starts, counts = np.unique(slots[order], return_index=True, return_counts=True)
        for slot, n, s in zip(present.tolist(), counts.tolist(), np.add.reduceat(q[order], starts, axis=0)):
            self.n[slot] = self.n.get(slot, 0) + n
            self.total[slot] = self.total.get(slot, 0) + s.astype(object)

    def batch(self) -> pa.RecordBatch:
        slots = list(self.n)
        return pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int32()), pa.array([self.n[s] for s in slots], pa.int64()),
             pa.array([[str(v) for v in self.total[s]] for s in slots], pa.list_(pa.string()))], ["slot", "n", "sums"])


def slot_means(vectors: DataFrame, dim: int, slots_of: Callable[[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]) -> dict[int, list[int]]:
    """floor(sum / count) of what ``slots_of`` assigns to each slot, per component.

    ``vectors`` has ``__x``. Each task adds its rows up first and gives one row per slot; sums per slot are added once more and come to the
    driver, one row a slot. Python's integers throughout, so no count or magnitude overflows.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            for slots, parts in slots_of(scaled(batch_vectors(b, dim))):
                sums.add(slots, parts)
        yield sums.batch()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        sums = [sum(map(int, column)) for column in zip(*pdf["sums"])]
        return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "means": [[str(s // n) for s in sums]]})

    parts = vectors.select(F.col("__x").alias("x")).mapInArrow(partial, "slot int, n long, sums array<string>")
    rows = parts.groupBy("slot").applyInPandas(total, "slot int, means array<string>").collect()
    return {r["slot"]: [int(v) for v in r["means"]] for r in rows}


def first_vectors(vectors: DataFrame, ids: list, key: str = "vec_id") -> dict:
    """The vector of each of the few given ids; of rows that share an id, the least."""
    if not ids:
        return {}
    rows = vectors.where(F.col(key).isin(ids)).groupBy(key).agg(F.min("__x").alias("x")).collect()
    return {r[key]: r["x"] for r in rows}


def long_or_none(values: np.ndarray) -> pa.Array:
    """Squared distances as longs; one that needs more than 63 bits is null."""
    return pa.array([v if v < 2**63 else None for v in values.tolist()], pa.int64())
