"""Geometry of one quad held as ``array<double>`` x0,y0,...,x3,y3 (TL,TR,BR,BL).

Measures are unrolled over the four corners, so they stay inside generated code;
corner re-ordering uses array functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

N = 4
EPS = 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def xs(q: Column) -> list[Column]:
    return [F.get(q, F.lit(2 * i)) for i in range(N)]


def ys(q: Column) -> list[Column]:
    return [F.get(q, F.lit(2 * i + 1)) for i in range(N)]


def pack(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[c for p in points for c in p])


def clamp(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def clip01(q: Column) -> Column:
    return F.transform(q, lambda c: clamp(c))


def is_finite_quad(q: Column) -> Column:
    """Eight values, none of them null, NaN or infinite."""
    ok = F.forall(q, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(q) == 8) & ok, F.lit(False))


# ---------------------------------------------------------------- corner order

def _points(q: Column) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in zip(xs(q), ys(q))])


def _flat(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def ccw_points(q: Column) -> Column:
    """Corners sorted by angle, as structs with x and y; of a null quad four structs of nulls."""
    px, py = xs(q), ys(q)
    cx = (px[0] + px[1] + px[2] + px[3]) / F.lit(4.0)
    cy = (py[0] + py[1] + py[2] + py[3]) / F.lit(4.0)
    keyed = F.array(*[
        F.struct(F.atan2(py[i] - cy, px[i] - cx).alias("a"), F.lit(i).alias("i"), px[i].alias("x"), py[i].alias("y"))
        for i in range(N)
    ])
    return F.sort_array(keyed)


def order_ccw(q: Column) -> Column:
    """Corners sorted by angle about the vertex mean."""
    return F.when(q.isNotNull(), _flat(ccw_points(q)))


def order_tlbr_angle(q: Column) -> Column:
    """Angle order, started at the corner with the least x+y, top edge first."""
    def rotate(pts: Column) -> Column:
        sums = F.transform(pts, lambda p: p["x"] + p["y"])
        start = F.array_position(sums, F.array_min(sums)).cast("int")
        rolled = F.concat(F.slice(pts, start, 4), F.slice(pts, F.lit(1), start - 1))
        return let(rolled, lambda r: F.when(
            F.get(r, F.lit(1))["y"] > F.get(r, F.lit(3))["y"],
            F.concat(F.slice(r, 1, 1), F.reverse(F.slice(r, 2, 3))),
        ).otherwise(r))
    return F.when(q.isNotNull(), _flat(let(ccw_points(q), rotate)))


def order_tlbr_sumdiff(q: Column) -> Column:
    """TL/BR by least/greatest x+y, TR/BL by least/greatest y-x; the first corner wins a tie."""
    px, py = xs(q), ys(q)

    def pick(keys: list[Column]) -> Column:
        return F.array_min(F.array(*[
            F.struct(keys[i].alias("k"), F.lit(i).alias("i"), px[i].alias("x"), py[i].alias("y")) for i in range(N)
        ]))
    s = [x + y for x, y in zip(px, py)]
    d = [y - x for x, y in zip(px, py)]
    corners = F.array(pick(s), pick(d), pick([-v for v in s]), pick([-v for v in d]))
    return F.when(q.isNotNull(), _flat(corners))


def order_tlbr_rows(q: Column) -> Column:
    """Two least-y corners are the top row (left first), the other two the bottom row (right first)."""
    px, py = xs(q), ys(q)
    by_y = F.sort_array(F.array(*[
        F.struct(py[i].alias("y"), F.lit(i).alias("i"), px[i].alias("x")) for i in range(N)
    ]))

    def row(pts: Column, at: int, sign: float) -> Column:
        two = F.transform(F.slice(pts, at, 2), lambda p: F.struct(
            (p["x"] * F.lit(sign)).alias("k"),
            # equal keys keep their order in the y-sorted list
            p["y"].alias("y0"), p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y")))
        return F.sort_array(two)
    return F.when(q.isNotNull(), _flat(let(by_y, lambda s: F.concat(row(s, 1, 1.0), row(s, 3, -1.0)))))


def roll_left(q: Column, k: Column) -> Column:
    """Corner k becomes the first corner."""
    n = (k * 2).cast("int")
    return F.concat(F.slice(q, n + 1, 8), F.slice(q, F.lit(1), n))


# ---------------------------------------------------------------- measures

def shoelace_signed(q: Column) -> Column:
    px, py = xs(q), ys(q)
    total = F.lit(0.0)
    for i in range(N):
        j = (i + 1) % N
        total = total + (px[i] * py[j] - px[j] * py[i])
    return total * F.lit(0.5)


def shoelace_area(q: Column) -> Column:
    return F.abs(shoelace_signed(q))


def bbox(q: Column) -> dict[str, Column]:
    px, py = xs(q), ys(q)
    b = {"xmin": F.least(*px), "ymin": F.least(*py), "xmax": F.greatest(*px), "ymax": F.greatest(*py)}
    b["w"] = b["xmax"] - b["xmin"]
    b["h"] = b["ymax"] - b["ymin"]
    b["area"] = b["w"] * b["h"]
    b["min_dim"] = F.least(b["w"], b["h"])
    return b


def border_margin(q: Column) -> Column:
    b = bbox(q)
    return F.least(b["xmin"], b["ymin"], 1.0 - b["xmax"], 1.0 - b["ymax"])


def border_margin_px(q: Column, w: Column, h: Column) -> Column:
    """Null when the image size is unknown."""
    b = bbox(q)
    m = F.least(b["xmin"] * w, b["ymin"] * h, (1.0 - b["xmax"]) * w, (1.0 - b["ymax"]) * h)
    return F.when(w.isNotNull() & h.isNotNull(), m)


def edge_lengths(q: Column) -> list[Column]:
    px, py = xs(q), ys(q)
    out = []
    for i in range(N):
        dx, dy = px[(i + 1) % N] - px[i], py[(i + 1) % N] - py[i]
        out.append(F.sqrt(dx * dx + dy * dy))
    return out


def edge_ratio(q: Column) -> Column:
    e = edge_lengths(q)
    lo, hi = F.least(*e), F.greatest(*e)
    return F.when(lo > EPS, F.try_divide(hi, lo)).when(lo.isNotNull(), F.lit(float("inf")))


def interior_angles(q: Column, eps: float = EPS, product_rule: bool = False) -> list[Column]:
    """Degrees at each corner; 0 where an adjacent edge is at most ``eps`` (or their product below 1e-10)."""
    px, py = xs(q), ys(q)
    out = []
    for i in range(N):
        p, n = (i - 1) % N, (i + 1) % N
        ax, ay, bx, by = px[p] - px[i], py[p] - py[i], px[n] - px[i], py[n] - py[i]
        la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
        flat = (la * lb < 1e-10) if product_rule else ((la <= eps) | (lb <= eps))
        cos = clamp(F.try_divide(ax * bx + ay * by, la * lb), -1.0, 1.0)
        out.append(F.when(flat, F.lit(0.0)).otherwise(F.degrees(F.acos(cos))))
    return out


def turn_crosses(q: Column) -> list[Column]:
    px, py = xs(q), ys(q)
    out = []
    for i in range(N):
        j, k = (i + 1) % N, (i + 2) % N
        out.append((px[j] - px[i]) * (py[k] - py[j]) - (py[j] - py[i]) * (px[k] - px[j]))
    return out


def is_convex(q: Column, tolerance: float = 1e-12) -> Column:
    """All turns have one sign; turns within ``tolerance`` are ignored. Expects angle order."""
    c = turn_crosses(q)
    any_left = (c[0] > tolerance) | (c[1] > tolerance) | (c[2] > tolerance) | (c[3] > tolerance)
    any_right = (c[0] < -tolerance) | (c[1] < -tolerance) | (c[2] < -tolerance) | (c[3] < -tolerance)
    return ~(any_left & any_right)


def is_convex_strict(q: Column) -> Column:
    """On the given order every turn is positive, or none is."""
    c = turn_crosses(q)
    positive = sum(((v > 0).cast("int") for v in c), F.lit(0))
    return (positive == 4) | (positive == 0)


def _side(p, q, r) -> Column:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _cross(a, b, c, d) -> Column:
    return ((_side(a, b, c) > 0) != (_side(a, b, d) > 0)) & ((_side(c, d, a) > 0) != (_side(c, d, b) > 0))


def _corners(q: Column) -> list[tuple[Column, Column]]:
    return list(zip(xs(q), ys(q)))


def is_self_intersecting(q: Column) -> Column:
    a, b, c, d = _corners(q)
    return _cross(a, b, c, d) | _cross(b, c, d, a)


def _tri_area(p, q, r) -> Column:
    return F.abs(_side(p, q, r)) * F.lit(0.5)


def _at_crossing(a, b, c, d, body: Callable[[tuple[Column, Column]], Column]) -> Column:
    """``body`` of the point where edges ab and cd cross, computed once."""
    sa, sb = _side(c, d, a), _side(c, d, b)
    point = let(F.try_divide(sa, sa - sb), lambda t: F.struct(
        (a[0] + t * (b[0] - a[0])).alias("x"), (a[1] + t * (b[1] - a[1])).alias("y")))
    return let(point, lambda k: body((k["x"], k["y"])))


def _if_crossing(q: Column, body: Callable, otherwise: Column) -> Column:
    """``body(x, p1, p2, p3, p4)`` for a self-crossing quad: x closes the triangles x,p1,p2 and x,p3,p4."""
    a, b, c, d = _corners(q)
    return (F.when(_cross(a, b, c, d), _at_crossing(a, b, c, d, lambda x: body(x, b, c, d, a)))
            .when(_cross(b, c, d, a), _at_crossing(b, c, d, a, lambda x: body(x, c, d, a, b)))
            .otherwise(otherwise))


def valid_area(q: Column) -> Column:
    """Area of the largest piece after a self-crossing quad is split at its crossing."""
    return _if_crossing(q, lambda x, p1, p2, p3, p4: F.greatest(_tri_area(x, p1, p2), _tri_area(x, p3, p4)),
                        shoelace_area(q))


def largest_piece(q: Column) -> Column:
    """The quad itself, or the larger triangle of a self-crossing one (last corner repeated)."""
    def bigger(x, p1, p2, p3, p4) -> Column:
        return (F.when(_tri_area(x, p1, p2) >= _tri_area(x, p3, p4), pack([x, p1, p2, p2]))
                .otherwise(pack([x, p3, p4, p4])))
    return _if_crossing(q, bigger, q)


def all_pieces(q: Column) -> Column:
    """Ring around both triangles of a self-crossing quad, each in the same direction."""
    return _if_crossing(q, lambda x, p1, p2, p3, p4: pack([x, p1, p2, x, p4, p3]), q)


def fill_ratio(q: Column) -> Column:
    """Valid area over bounding-box area. Expects angle order."""
    b = bbox(q)
    return F.when(b["area"] > EPS, F.try_divide(valid_area(q), b["area"])).when(b["area"].isNotNull(), F.lit(0.0))


def out_of_bounds(q: Column, tol: float = 0.02) -> Column:
    return F.exists(q, lambda c: (c < -tol) | (c > 1.0 + tol))


def quad_is_sane(q: Column) -> Column:
    b = bbox(q)
    return F.coalesce(
        is_finite_quad(q)
        & (F.least(b["xmin"], b["ymin"]) >= -0.05) & (F.greatest(b["xmax"], b["ymax"]) <= 1.05)
        & (shoelace_area(q) >= 1e-4) & (b["w"] >= 1e-3) & (b["h"] >= 1e-3),
        F.lit(False))


# ---------------------------------------------------------------- issue lists

def printed(v: Column, digits: int) -> Column:
    """``v`` to ``digits`` decimals as the text files print it: the exact binary value decides, only a true half goes to even.

    0.075 is a little less than its decimal and prints as 0.07. The product with the power of ten is split into itself and its
    rounding error (Dekker), so the comparison with the half is exact.
    """
    scale, split = 10.0 ** digits, 134217729.0
    high = scale * split - (scale * split - scale)
    low = scale - high

    def rounded(a: Column) -> Column:
        def parts(x: Column) -> Column:
            upper = x * split - (x * split - x)
            lower, p = x - upper, x * scale
            err = ((upper * high - p) + upper * low + lower * high) + lower * low
            return F.struct(p.alias("p"), err.alias("e"), F.floor(p).cast("double").alias("f"))

        def pick(c: Column) -> Column:
            over = c["p"] - c["f"] - 0.5
            up = (over > 0) | ((over == 0) & ((c["e"] > 0) | ((c["e"] == 0) & (c["f"] % 2 == 1))))
            return (c["f"] + F.when(up, 1.0).otherwise(0.0)) / scale
        return let(parts(a), pick)
    r = rounded(F.abs(v))
    return F.when(F.abs(v) < 1e15 / scale, F.when(v < 0, -r).otherwise(r)).otherwise(v)


def fixed(template: str, *values: Column) -> Column:
    """``format_string`` that rounds as the text files do (see :func:`printed`), not by the shortest decimal."""
    digits = [d for d in re.findall(r"%[-0-9]*(?:\.(\d+))?[a-z]", template)]
    return F.format_string(template, *[printed(v.cast("double"), int(d)) if d else v for v, d in zip(values, digits)])


def _issues(*items: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in items]))


def corner_order_issues(q: Column, slack: float = 0.1) -> Column:
    px, py = xs(q), ys(q)
    return _issues(
        (py[0] > py[3] + slack, F.lit("TL_below_BL")),
        (py[1] > py[2] + slack, F.lit("TR_below_BR")),
        (px[0] > px[1] + slack, F.lit("TL_right_of_TR")),
        (px[3] > px[2] + slack, F.lit("BL_right_of_BR")),
    )


def edge_touch_issues(q: Column, t: float = 0.02) -> Column:
    b = bbox(q)
    return _issues(
        (b["xmin"] < t, fixed("touches_left_edge:%.3f", b["xmin"])),
        (b["xmax"] > 1 - t, fixed("touches_right_edge:%.3f", b["xmax"])),
        (b["ymin"] < t, fixed("touches_top_edge:%.3f", b["ymin"])),
        (b["ymax"] > 1 - t, fixed("touches_bottom_edge:%.3f", b["ymax"])),
    )


def quad_issues(q: Column) -> Column:
    """Nine label rules on the given corner order; each hit is ``type`` or ``type: value``."""
    b = bbox(q)
    area = shoelace_area(q)
    aspect = F.greatest(F.try_divide(b["w"], b["h"]), F.try_divide(b["h"], b["w"]))
    e = edge_lengths(q)
    lo, hi = F.least(*e), F.greatest(*e)
    ang = interior_angles(q, product_rule=True)
    amin, amax = F.least(*ang), F.greatest(*ang)
    fill = F.try_divide(area, b["area"])
    return _issues(
        ((b["xmin"] < -0.01) | (b["xmax"] > 1.01) | (b["ymin"] < -0.01) | (b["ymax"] > 1.01),
         fixed("coords_outside_bounds: x=[%.3f,%.3f] y=[%.3f,%.3f]", b["xmin"], b["xmax"], b["ymin"], b["ymax"])),
        (area > 0.95, fixed("very_large_bbox: area=%.3f", area)),
        ((b["w"] > 0) & (b["h"] > 0) & (aspect > 5), fixed("extreme_aspect_ratio: %.1f", aspect)),
        (lo < 0.02, fixed("very_short_edge: %.4f", lo)),
        ((lo > 0) & (F.try_divide(hi, lo) > 10), fixed("edge_ratio_extreme: %.1f", F.try_divide(hi, lo))),
        (amin < 20, fixed("very_acute_angle: %.1f°", amin)),
        (amax > 160, fixed("very_obtuse_angle: %.1f°", amax)),
        (~is_convex_strict(q), F.lit("non_convex_quad")),
        ((b["area"] > 0.01) & (fill < 0.3), fixed("possibly_self_intersecting: area_ratio=%.2f", fill)),
    )


# ---------------------------------------------------------------- coordinate transforms

def _map_xy(q: Column, fx: Callable[[Column], Column], fy: Callable[[Column], Column]) -> Column:
    return F.when(q.isNotNull(), pack([(fx(x), fy(y)) for x, y in zip(xs(q), ys(q))]))


def to_px(q: Column, w: Column, h: Column) -> Column:
    return _map_xy(q, lambda x: x * w, lambda y: y * h)


def to_norm(q: Column, w: Column, h: Column, clip_inside: bool = False) -> Column:
    """Pixels to [0,1]; ``clip_inside`` first limits pixels to w-1, h-1."""
    def scale(v: Column, size: Column) -> Column:
        if clip_inside:
            v = F.least(F.greatest(v, F.lit(0.0)), size - 1.0)
        return clamp(F.try_divide(v, size))
    return _map_xy(q, lambda x: scale(x, w), lambda y: scale(y, h))


def rotate(q: Column, angle_deg: Column, aspect: float = 1.0) -> Column:
    """Rotate about the image centre so that coordinates follow an image turned by +angle."""
    rad = F.radians(-angle_deg)
    c, s = F.cos(rad), F.sin(rad)
    pts = []
    for x, y in zip(xs(q), ys(q)):
        dx, dy = (x - 0.5) * aspect, y - 0.5
        pts.append(((dx * c - dy * s) / F.lit(float(aspect)) + 0.5, dx * s + dy * c + 0.5))
    return F.when(q.isNotNull(), pack(pts))


def scale_about_centre(q: Column, factor: Column) -> Column:
    def f(v: Column) -> Column:
        return 0.5 + (v - 0.5) * factor
    return _map_xy(q, f, f)


def hflip(q: Column) -> Column:
    """Mirror in x and swap left and right corners."""
    p = _corners(q)
    return F.when(q.isNotNull(), pack([(1.0 - p[i][0], p[i][1]) for i in (1, 0, 3, 2)]))
