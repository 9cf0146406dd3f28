"""Codes and clusters of vectors against plain versions, with ties, odd rows and huge components."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quadlab.llm import centroids, queries, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, x int, code string, slot int, cluster int, n long"


def rows_of(vecs, labels=None):
    return [(i, v, (labels or [0])[i % len(labels or [0])], 7, "z", 1, 2, 3) for i, v in enumerate(vecs)]


def ints(v):
    return [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256) for x in v]


def nearest(q, entries):
    d = [sum((a - b) ** 2 for a, b in zip(q, e)) for e in entries]
    return d.index(min(d)), min(d)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 4), min_size=1, max_size=64), st.lists(st.tuples(*[st.integers(-9, 9)] * 4), min_size=1, max_size=40))
def test_slices_find_the_nearest_and_the_lowest_of_ties(entries, queries_):
    at, d = vector_codes.Slices(np.array(entries, dtype=np.int64)).nearest(np.array(queries_, dtype=np.int64))
    assert list(zip(at.tolist(), d.tolist())) == [nearest(q, entries) for q in queries_]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 3), min_size=1, max_size=50), st.lists(st.tuples(*[st.integers(-9, 9)] * 3), min_size=1, max_size=40))
def test_tree_finds_the_nearest_and_the_smallest_of_ties(points, queries_):
    at, d = centroids.VantageTree(np.array(points, dtype=np.int64)).nearest(np.array(queries_, dtype=np.int64))
    assert list(zip(at.tolist(), d.tolist())) == [nearest(q, points) for q in queries_]


def test_tree_with_large_components_is_exact():
    rng = np.random.default_rng(5)
    points, q = (rng.integers(-2**25, 2**25, (n, 64)) for n in (40, 30))
    q[3] = points[7]
    at, d = centroids.VantageTree(points).nearest(q)
    assert list(zip(at.tolist(), d.tolist())) == [nearest(x, points.tolist()) for x in q.tolist()]


def plain_codes(rows):
    kept = [(i, ints(v), lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // 16
    first = sorted({i: v for i, v, _ in reversed(kept)}.items())[:64]
    books = [[v[p * w:(p + 1) * w] for _, v in first] for p in range(16)]

    def code(v):
        return [nearest(v[p * w:(p + 1) * w], books[p]) for p in range(16)]

    for _ in range(2):
        held = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p, (e, _) in enumerate(code(v)):
                held[p][e].append(v[p * w:(p + 1) * w])
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(hs, b)] for hs, b in zip(held, books)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for e, _ in code(v)), sum(d for _, d in code(v)), lab) for i, v, lab in kept]
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted((i, c, e if e < 2**63 else None, total[lab], sha) for i, c, e, lab in out)


def odd_vectors(n=90, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    vecs = [list(map(float, rng.normal(size=dim))) for _ in range(n)]
    for i in range(20, min(50, n)):
        vecs[i] = list(vecs[9])  # a third of the rows are one vector
    return vecs


def test_codes_match_a_plain_version(spark):
    vecs = odd_vectors()
    vecs[5], vecs[6], vecs[7], vecs[8] = None, [None] + vecs[6][1:], [math.nan] + vecs[7][1:], [math.inf] + vecs[8][1:]
    rows = rows_of(vecs, [0, 1, None])
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_codes([(r[0], r[1], r[2]) for r in rows])
    got = sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(df).collect())
    assert got == want


def test_codes_of_repeats_other_lengths_missing_ids_and_nothing(spark):
    vecs = odd_vectors(6)
    rows = rows_of(vecs) + rows_of(vecs)[:1] + [(None, vecs[1], None, 1, "", 1, 1, 1), (50, [1.0] * 16, 1, 1, "", 1, 1, 1), (51, [1.0] * 5, 1, 1, "", 1, 1, 1), (52, [], 1, 1, "", 1, 1, 1)]
    got = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and all(r.error == 0 for r in got)
    assert len({r.code for r in got if r.vec_id == 0}) == 1 and sum(r.vec_id is None for r in got) == 1
    assert vector_codes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, 1, 1, "", 1, 1, 1), (2, [], 1, 1, "", 1, 1, 1)], SCHEMA)
    assert vector_codes.compressed(none).count() == 0 and centroids.clustered(none).count() == 0


def test_huge_components_are_exact(spark):
    vecs = odd_vectors(80)
    vecs[70], vecs[71] = [1e30] * 32, [-1e7] * 32
    rows = rows_of(vecs)
    got = sorted((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in vector_codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(i, c, e, s) for i, c, e, _, s in plain_codes([(r[0], r[1], r[2]) for r in rows])]
    out = centroids.clustered(spark.createDataFrame(rows, SCHEMA), dim=32).collect()
    assert len(out) == 80


def test_codes_restore_vectors_within_their_error(spark):
    df = spark.createDataFrame(rows_of(odd_vectors()), SCHEMA)
    kept = vectors.whole_vectors(df)
    books = vector_codes.codebooks(kept, 32)
    coded = vector_codes.coded(kept, books, 32)
    back = {r.vec_id: r.vector for r in vector_codes.decoded(coded, books).collect()}
    x = {r[0]: ints(r[1]) for r in df.collect()}
    for r in coded.collect():
        assert sum((a - 256 * b) ** 2 for a, b in zip(x[r.vec_id], back[r.vec_id])) == r.error


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, ints(v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())
    points = [v for _, v in order[:k]]
    for _ in range(rounds):
        held = [[] for _ in points]
        for _, v in kept:
            held[nearest(v, points)[0]].append(v)
        points = [[sum(c) // len(h) for c in zip(*h)] if h else p for h, p in zip(held, points)]
    out = [(i, *nearest(v, points)) for i, v in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out)


def test_clusters_match_a_plain_version(spark):
    vecs = odd_vectors(120, 64)
    vecs[5], vecs[6], vecs[7] = None, [None] + vecs[6][1:], vecs[7][:63]
    rows = rows_of(vecs)
    got = centroids.clustered(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_clusters([(r[0], r[1]) for r in rows])
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == want


def test_clusters_of_repeats_missing_ids_and_nothing(spark):
    vecs = odd_vectors(10, 64)
    rows = rows_of(vecs) + rows_of(vecs)[:2] + [(None, vecs[0], 1, 1, "", 1, 1, 1)]
    got = centroids.clustered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 13 and all(r.distance == 0 and r.inertia == 0 for r in got)
    assert centroids.clustered(spark.createDataFrame([], SCHEMA)).count() == 0
    only = centroids.clustered(spark.createDataFrame([(None, v, 1, 1, "", 1, 1, 1) for v in vecs], SCHEMA)).collect()
    assert len(only) == 10 and all(r.distance == 0 for r in only)


@pytest.mark.parametrize("name", ["op11_vector_code_compression", "op12_centroid_clustering"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    rel = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(cols).collect())) == sorted(rel.fetchall())
