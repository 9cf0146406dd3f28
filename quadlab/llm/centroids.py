"""Clustering vectors around centroids, which are searched through a vantage-point tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadlab.llm.common import written
from quadlab.llm.vectors import batch_vectors, compact, first_vectors, long_or_none, plain_nearest, scaled, slot_means, whole_vectors

#: Centroids, components, rounds, the salt of the hash that picks the first centroids, and how many centroids a leaf holds.
CLUSTERS, DIM, ROUNDS, SALT, LEAF = 40, 64, 5, "2", 4
#: Share by which the pruning radius is widened, far above the rounding of roots and sums: an entry at the very radius is still visited.
SLACK = 1e-9


@dataclass
class Node:
    """A vantage point with two children, or a leaf. ``low`` and ``high`` bound the distances of what it holds from its parent's vantage point."""

    low: float
    high: float
    entries: list[int]
    children: list[int] = field(default_factory=list)


class VantageTree:
    """Vantage-point tree over a few points; ``nearest`` is exact."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.nodes: list[Node] = []
        self.plain = points.dtype == object
        if len(points) and not self.plain:
            self._grow(list(range(len(points))), 0.0, float("inf"), leaf)

    def _grow(self, held: list[int], low: float, high: float, leaf: int) -> int:
        here = len(self.nodes)
        self.nodes.append(Node(low, high, held))
        if len(held) > leaf:
            p = self.points[held].astype(np.float64)
            apart = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
            # the point whose distances spread most tells the others apart best
            vantage = int(apart.var(axis=1).argmax())
            order = [i for i in np.argsort(apart[vantage], kind="stable").tolist() if i != vantage]
            halves = order[:len(order) // 2], order[len(order) // 2:]
            self.nodes[here].entries = [held[vantage]]
            self.nodes[here].children = [
                self._grow([held[i] for i in half], float(apart[vantage][half].min()), float(apart[vantage][half].max()), leaf) for half in halves]
        return here

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest point; ties go to the smaller index.

        Best-first branch and bound for each query: always the open node with the least bound is next, until that bound is beyond the best
        distance. All queries of a batch take their next step together; those at the same node are compared with it at once.
        """
        if self.plain or q.dtype == object:
            return plain_nearest(q, self.points)
        # sums of squares below 2^53 are exact as doubles
        most = max(int(np.abs(q).max(initial=0)), int(np.abs(self.points).max(initial=0)))
        kind = np.float64 if q.shape[1] * (2 * most) ** 2 < 2**53 else np.int64
        q, points = q.astype(kind), self.points.astype(kind)
        if q.shape[1] * (2 * most) ** 2 >= 2**63:
            return plain_nearest(q.astype(object), self.points)
        bounds = np.full((len(q), len(self.nodes)), np.inf)
        bounds[:, 0] = 0
        best, at = np.full(len(q), np.iinfo(np.int64).max), np.zeros(len(q), dtype=np.int64)
        radius, rows = np.full(len(q), np.inf), np.arange(len(q))
        while len(rows):
            node = bounds[rows].argmin(axis=1)
            bound = bounds[rows, node]
            go = np.isfinite(bound) & (bound <= radius[rows] * (1 + SLACK))
            rows, node = rows[go], node[go]
            for u in np.unique(node).tolist():
                here, tree = rows[node == u], self.nodes[u]
                for c in tree.entries:
                    diff = q[here] - points[c]
                    d = np.einsum("ij,ij->i", diff, diff).astype(np.int64)
                    nearer = (d < best[here]) | ((d == best[here]) & (c < at[here]))
                    best[here[nearer]], at[here[nearer]] = d[nearer], c
                radius[here] = np.sqrt(best[here].astype(np.float64))
                passed = bounds[here, u]
                bounds[here, u] = np.inf
                for child in tree.children:  # d is the distance from the vantage point, the only entry of an inner node
                    low, high = self.nodes[child].low, self.nodes[child].high
                    root = np.sqrt(d.astype(np.float64))
                    gap = np.maximum(root - high, low - root) - SLACK * (root + high)
                    bounds[here, child] = np.maximum(passed, gap)
        return at, best


def _first_centroids(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors whose salted id has the smallest sha256, one per id; without any id, the least vectors."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    ids = [r[0] for r in vectors.where("vec_id is not null").select("vec_id").distinct().orderBy(digest, "vec_id").limit(clusters).collect()]
    found = first_vectors(vectors, ids)
    x = [found[i] for i in ids] or [r[0] for r in vectors.select("__x").distinct().orderBy("__x").limit(clusters).collect()]
    return compact(scaled(np.array(x, dtype=np.float64)))


def centroids(vectors: DataFrame, clusters: int = CLUSTERS, dim: int = DIM, rounds: int = ROUNDS, salt: str = SALT) -> np.ndarray:
    """The centroids after all rounds, from rows with ``vec_id`` and ``__x``; the driver holds ``clusters`` rows, the tree over them is broadcast anew each round."""
    points = _first_centroids(vectors, clusters, salt)
    sc = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        tree = sc.broadcast(VantageTree(points))

        def slots_of(q: np.ndarray, tree=tree) -> list[tuple[np.ndarray, np.ndarray]]:
            return [(tree.value.nearest(q)[0], q)]

        moved = points.astype(object)
        for c, mean in slot_means(vectors, dim, slots_of).items():
            moved[c] = mean
        points = compact(moved)
        tree.unpersist()
    return points


def assigned(vectors: DataFrame, points: np.ndarray, dim: int = DIM) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector: the nearest centroid and the squared distance from it."""
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree(points))
    rows = vectors.select("vec_id", F.col("__x").alias("x"))
    schema = rows.drop("x").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = tree.value.nearest(scaled(batch_vectors(b, dim)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), long_or_none(d)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, schema)


def clustered(rows: DataFrame, vector: str = "embedding", clusters: int = CLUSTERS, dim: int = DIM, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each row of ``rows`` (``vec_id``, ``vector``; other columns are ignored).

    Rows whose vector is null, has not exactly ``dim`` components or holds nulls, NaN or infinities are dropped. A repeated row is clustered and counts
    each time; an id starts one centroid at most, its least vector; rows without an id start none (unless none has an id). With fewer ids than
    ``clusters`` there are fewer centroids. Equal centroids stay, and the first takes the vectors. Distances and sums that need more than 63 bits are null.
    An empty table gives no rows.
    """
    kept = written(whole_vectors(rows.select("vec_id", vector), vector).where(F.size("__x") == dim).select("vec_id", "__x"))
    spark = kept.sparkSession
    if not kept.take(1):
        zero = F.lit(0).cast("long")
        return kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), zero.alias("distance"), zero.alias("cluster_inertia"), zero.alias("inertia"), F.lit("").alias("centroid_sha256"))
    points = centroids(kept, clusters, dim, rounds, salt)
    out = written(assigned(kept, points, dim))
    sums = {r["cluster"]: int(r["s"]) if r["s"] is not None else None for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(s or 0 for s in sums.values())

    def long(v: int | None) -> int | None:
        return v if v is not None and v < 2**63 else None

    # one row per centroid
    table = spark.createDataFrame(
        [(c, long(sums[c]), long(total), hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest()) for c in sorted(sums)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
