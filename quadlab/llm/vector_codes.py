"""Compressing vectors to codes: per part a codebook of up to 64 entries, searched by slicing each dimension and intersecting bit masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadlab.llm.common import written
from quadlab.llm.vectors import batch_vectors, compact, first_vectors, long_or_none, plain_nearest, scaled, slot_means, whole_vectors

#: Parts of a vector, entries of a codebook (one bit of a 64-bit mask each), rounds of refinement.
PARTS, ENTRIES, ROUNDS = 16, 64, 2


class Slices:
    """The entries of one codebook, sorted by each coordinate, with the mask of the entries before each place."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a mask has 64 bits")
        self.entries = entries
        self.plain = entries.dtype == object
        if not self.plain:
            self.order = entries.argsort(axis=0, kind="stable")
            self.sorted = np.take_along_axis(entries, self.order, axis=0)
            self.before = np.zeros((len(entries) + 1, entries.shape[1]), dtype=np.uint64)
            self.before[1:] = np.bitwise_or.accumulate(np.uint64(1) << self.order.astype(np.uint64), axis=0)

    def _squared(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = q - self.entries[at]
        return (d * d).sum(axis=1)

    def candidates(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries that lie within ``radius`` of ``q`` in every coordinate.

        The slice of a dimension is the difference of two prefix masks; the slices of all dimensions are intersected.
        """
        mask = np.full(len(q), np.uint64(2**64 - 1))
        for d in range(q.shape[1]):
            low = np.searchsorted(self.sorted[:, d], q[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], q[:, d] + radius, "right")
            mask &= self.before[high, d] ^ self.before[low, d]
        return mask

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry; ties go to the lower index.

        The initial radius is the least distance to the entries that are next in one coordinate: no nearer entry, nor an
        equally near one, is outside it. Candidates are then taken bit by bit, from the lowest, and compared exactly.
        """
        if self.plain or q.dtype == object:
            return plain_nearest(q, self.entries)
        bound = None
        for d in range(q.shape[1]):
            place = np.minimum(np.searchsorted(self.sorted[:, d], q[:, d]), len(self.entries) - 1)
            reach = self._squared(q, self.order[place, d])
            bound = reach if bound is None else np.minimum(bound, reach)
        # one more than the root covers its rounding
        mask = self.candidates(q, np.sqrt(bound.astype(np.float64)).astype(np.int64) + 1)
        best, at = np.full(len(q), np.iinfo(np.int64).max), np.zeros(len(q), dtype=np.int64)
        rows = np.arange(len(q))
        while len(rows):
            left = mask[rows]
            lowest = left & (~left + np.uint64(1))
            entry = np.frexp(lowest.astype(np.float64))[1] - 1
            d = self._squared(q[rows], entry)
            nearer = d < best[rows]
            best[rows[nearer]], at[rows[nearer]] = d[nearer], entry[nearer]
            mask[rows] = left ^ lowest
            rows = rows[mask[rows] != 0]
        return at, best


def _dimension(vectors: DataFrame, parts: int) -> int:
    """The commonest length that can be cut into equal parts; of equally common ones the longest; 0 without any."""
    n = F.size("__x")
    row = (vectors.where((n > 0) & (n % parts == 0)).groupBy(n.alias("n")).agg(F.count("*").alias("rows"))
           .orderBy(F.desc("rows"), F.desc("n")).first())
    return row["n"] if row else 0


def _first_books(vectors: DataFrame, dim: int, parts: int, entries: int) -> list[np.ndarray]:
    ids = [r[0] for r in vectors.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    found = first_vectors(vectors, ids)
    if not ids:  # no row has an id: the least vectors start the codebooks
        found = {i: r[0] for i, r in enumerate(vectors.select("__x").distinct().orderBy("__x").limit(entries).collect())}
        ids = list(found)
    x = scaled(np.array([found[i] for i in ids], dtype=np.float64)).reshape(len(ids), parts, dim // parts)
    return [compact(x[:, p]) for p in range(parts)]


def codebooks(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The refined codebook of each part, from rows with ``vec_id`` and ``__x`` of ``dim`` components.

    A codebook starts as that part of the vectors with the smallest ids; every round assigns all parts to their nearest entry and
    replaces each entry that was used by the componentwise floor of its parts' mean. The driver holds ``parts * entries`` entries.
    """
    books = _first_books(vectors, dim, parts, entries)
    width = dim // parts
    for _ in range(rounds):
        slices = [Slices(b) for b in books]

        def slots_of(q: np.ndarray, slices=slices) -> list[tuple[np.ndarray, np.ndarray]]:
            cut = [q[:, p * width:(p + 1) * width] for p in range(parts)]
            return [(s.nearest(c)[0] + p * entries, c) for p, (s, c) in enumerate(zip(slices, cut))]

        means = slot_means(vectors, dim, slots_of)
        moved = [b.astype(object) for b in books]
        for slot, mean in means.items():
            moved[slot // entries][slot % entries] = mean
        books = [compact(b) for b in moved]
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """``vec_id, label, code, error`` of every vector under given codebooks: two hex digits per part, and the squared distances summed over parts."""
    slices, parts = [Slices(b) for b in books], len(books)
    width = dim // parts if parts else 0
    rows = vectors.select("vec_id", "label", F.col("__x").alias("x"))
    schema = rows.drop("x").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = scaled(batch_vectors(b, dim))
            codes, error = np.empty((len(q), parts), dtype=np.uint8), 0
            for p, s in enumerate(slices):
                at, d = s.nearest(q[:, p * width:(p + 1) * width])
                codes[:, p] = at
                error = error + d
            texts = codes.tobytes().hex()
            code = pa.array([texts[i:i + 2 * parts] for i in range(0, len(texts), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, long_or_none(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def compressed(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each row of ``rows`` (``vec_id``, ``label``, ``vector``; other columns are ignored).

    Rows whose vector is null or holds nulls, NaN or infinities are dropped. So are rows of another length than the commonest one that can be cut
    into equal parts. A repeated row is coded each time and counts each time; of rows that share an id the least vector may start a codebook; rows without an
    id are coded and never start one (unless none has an id). Fewer ids than entries give shorter codebooks; equal entries stay, and the first is
    used. Null labels are one label. An error that needs more than 63 bits is null. An empty table gives no rows.
    """
    kept = written(whole_vectors(rows.select("vec_id", "label", vector), vector).select("vec_id", "label", "__x"))
    dim = _dimension(kept, parts)
    kept = kept.where(F.size("__x") == dim)
    books = codebooks(kept, dim, parts, entries, rounds) if dim else []
    out = written(coded(kept, books, dim)) if dim else kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    sums = out.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return (out.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, vector`` from ``vec_id, code``: the entries that the code names, scaled back."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(v) / 256) for v in e]) for e in b.tolist()]) for b in books])
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return codes.select("vec_id", F.flatten(F.array(*[entries[p][i] for p, i in enumerate(at)])).alias("vector"))
