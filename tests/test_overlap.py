"""Polygon IoU against fixed vectors, an independent clipping routine and its own symmetries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlab.functions import geometry as G
from quadlab.functions.overlap import bbox_iou, ring_area, ring_overlap, with_polygon_iou

SQUARE = [.2, .2, .8, .2, .8, .8, .2, .8]
SHIFTED = [.3, .3, .9, .3, .9, .9, .3, .9]
CONCAVE = [0., 0., 1., 0., .3, .3, 0., 1.]
BOWTIE = [0., 0., 1., 0., 0., 1., 1., 1.]


def iou(spark, pairs, **kw):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a array<double>, b array<double>")
    return [r.iou for r in with_polygon_iou(df, [("a", "b", "iou")], **kw).orderBy("id").collect()]


def clip_area(subject, clip):
    """Area of a polygon clipped by the half-planes of a convex counter-clockwise one."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        def d(p):
            return (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        nxt = []
        for p, q in zip(out, out[1:] + out[:1]):
            dp, dq = d(p), d(q)
            if dp >= 0:
                nxt.append(p)
            if (dp > 0) != (dq > 0) and dp != dq:
                t = dp / (dp - dq)
                nxt.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = nxt
        if not out:
            return 0.0
    return abs(area(out))


def area(pts):
    return 0.5 * sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1]))


def points(q):
    return list(zip(q[0::2], q[1::2]))


def random_quad(rng, convex):
    while True:
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(4))
        cx, cy = rng.uniform(.3, .7), rng.uniform(.3, .7)
        radii = [rng.uniform(.03, .3) for _ in angles]
        pts = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles, radii)]
        if max((b - a) % (2 * math.pi) for a, b in zip(angles, angles[1:] + angles[:1])) > math.pi - .1:
            continue
        turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(pts, pts[1:] + pts[:1], pts[2:] + pts[:2])]
        if convex == (min(turns) > 0):
            return [v for p in pts for v in p]


def test_fixed_vectors(spark):
    same, moved, apart = iou(spark, [(SQUARE, SQUARE), (SQUARE, SHIFTED), (SQUARE, [1.5 + v for v in SQUARE])])
    assert same == pytest.approx(1.0, abs=1e-12)
    assert moved == pytest.approx(.25 / .47, abs=1e-12)
    assert apart == 0.0


def test_against_half_plane_clipping(spark):
    rng = random.Random(7)
    pairs = [(random_quad(rng, i % 3 != 0), random_quad(rng, True)) for i in range(300)]
    got = iou(spark, pairs)
    for (a, b), v in zip(pairs, got):
        inter = clip_area(points(a), points(b))
        union = abs(area(points(a))) + abs(area(points(b))) - inter
        assert v == pytest.approx(inter / union, abs=1e-9)


def test_two_concave_quads_against_a_fine_grid(spark):
    rng = random.Random(3)
    pairs = [(random_quad(rng, False), random_quad(rng, False)) for _ in range(15)]
    g = (np.arange(1200) + .5) / 1200
    x, y = np.meshgrid(g, g)

    def inside(q):
        hit = np.zeros_like(x, dtype=bool)
        p = points(q)
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
            if ay != by:
                hit ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return hit
    for (a, b), v in zip(pairs, iou(spark, pairs)):
        m, n = inside(a), inside(b)
        assert v == pytest.approx((m & n).sum() / max((m | n).sum(), 1), abs=5e-3)


def test_symmetry_range_and_rotation(spark):
    rng = random.Random(11)
    pairs = [(random_quad(rng, i % 2 == 0), random_quad(rng, i % 3 == 0)) for i in range(200)]
    fwd, back = iou(spark, pairs), iou(spark, [(b, a) for a, b in pairs])
    rolled = iou(spark, [(a[2:] + a[:2], b[6:] + b[:6]) for a, b in pairs])
    flipped = iou(spark, [([v for p in points(a)[::-1] for v in p], b) for a, b in pairs])
    assert np.allclose(fwd, back, atol=1e-12) and np.allclose(fwd, rolled, atol=1e-12) and np.allclose(fwd, flipped, atol=1e-12)
    assert all(0 <= v <= 1 for v in fwd)


def test_self_crossing_modes(spark):
    full = [0., 0., 1., 0., 1., 1., 0., 1.]
    pair = [(BOWTIE, full)]
    assert iou(spark, pair)[0] == pytest.approx(.25)           # one of two equal triangles
    assert iou(spark, pair, mode="whole")[0] == pytest.approx(.5)
    assert iou(spark, pair, mode="strict")[0] == 0.0
    assert iou(spark, pair, mode="bbox_fallback")[0] == pytest.approx(1.0, abs=1e-6)
    assert iou(spark, pair, order="ccw")[0] == pytest.approx(1.0)


def test_nulls_and_empty_polygons(spark):
    flat = [0., 0., 1., 1., 0., 0., 1., 1.]
    got = iou(spark, [(None, SQUARE), (flat, SQUARE)], order="ccw")
    assert got == [None, None]
    assert iou(spark, [(flat, SQUARE)]) == [0.0]


def test_ring_form_agrees_with_quad_form(spark):
    rng = random.Random(5)
    rows = [(i, random_quad(rng, True), random_quad(rng, False)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    ring = ring_overlap(a, b) / (ring_area(a) + ring_area(b) - ring_overlap(a, b))
    for r in with_polygon_iou(df, [("a", "b", "iou")]).withColumn("ring", ring).collect():
        assert r.ring == pytest.approx(r.iou, abs=1e-12)


def test_filters_stay_above_the_calculation(spark):
    df = spark.createDataFrame([(SQUARE, SHIFTED)], "a array<double>, b array<double>")
    plan = with_polygon_iou(df, [("a", "b", "iou")]).where("iou < 0.9")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") < plan.index("Project")
    assert plan.count("Filter") == 1


def test_bbox_iou(spark):
    df = spark.createDataFrame([(SQUARE, SHIFTED)], "a array<double>, b array<double>")
    assert df.select(bbox_iou(F.col("a"), F.col("b"))).first()[0] == pytest.approx(.25 / .47)


def test_orders_are_stable(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(random_quad(rng, True),) for _ in range(100)], "q array<double>")
    for order in (G.order_ccw, G.order_tlbr_angle, G.order_tlbr_sumdiff, G.order_tlbr_rows):
        once = df.select(order(F.col("q")).alias("q"))
        for r in once.select("q", order(F.col("q")).alias("again")).collect():
            assert r.q == r.again


def test_corner_order_of_a_square(spark):
    mixed = [.8, .8, .2, .2, .2, .8, .8, .2]
    df = spark.createDataFrame([(mixed,)], "q array<double>")
    for order in (G.order_tlbr_angle, G.order_tlbr_sumdiff, G.order_tlbr_rows):
        assert df.select(order(F.col("q"))).first()[0] == SQUARE
