"""Exact polygon IoU as DataFrame projections.

For a closed ring every vertical line meets as many rightward as leftward edges, so the area
common to two rings is half the signed sum, over all pairs of their edges, of the area between
the two edges where their x-ranges overlap. That needs no clipping, no convexity test and no
branches: sixteen short terms for two quads, each continuous in the coordinates.

The sixteen terms are too long for one JIT-compiled method, and so are the corner orders and the
edges of several quads. Each of these projections holds a lambda, which keeps it out of whole-stage
code; Spark then writes each repeated sub-expression as its own small method, about five times
faster than one large method. The lambdas are short, since Spark interprets what is in them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quadlab.functions import geometry as G
from quadlab.functions.fence import computed

SNAP = 1e-14
#: Steps of an IoU. The sum of sixteen terms is good to some 1e-15, so a ratio of exactly 0.75 may come out just below it; on
#: this grid it is 0.75 again, and equal quads have equal IoUs.
GRID = 1e13


# The per-quad steps below are SQL text over a named column: one call builds what would otherwise be
# hundreds of Column objects per quad.

def _x(q: str, i: int) -> str:
    return f"get(`{q}`, {2 * (i % 4)})"


def _y(q: str, i: int) -> str:
    return f"get(`{q}`, {2 * (i % 4) + 1})"


def _px(q: str, i: int) -> str:
    return f"get(`{q}`, {i % 4}).x"


def _py(q: str, i: int) -> str:
    return f"get(`{q}`, {i % 4}).y"


def _alone(flag: str) -> str:
    """The same truth value by a lambda: keeps the projection out of whole-stage code."""
    return f"exists(array({flag}), c -> c)"


def _edge_columns(q: str, tag: str, x=_x, y=_y) -> list[str]:
    """Per edge: left x, right x, y at the left end, slope, direction."""
    out = []
    for i in range(4):
        x0, y0, x1, y1 = x(q, i), y(q, i), x(q, i + 1), y(q, i + 1)
        parts = {
            "l": f"least({x0}, {x1})",
            "r": f"greatest({x0}, {x1})",
            "y": f"if({x0} <= {x1}, {y0}, {y1})",
            "m": f"try_divide({y1} - {y0}, {x1} - {x0})",
            "s": f"if({x0} < {x1}, 1D, -1D)",
        }
        out += [f"coalesce({e}, 0D) AS {tag}{k}{i}" for k, e in parts.items()]
    return out


def _area(q: str, x=_x, y=_y) -> str:
    terms = [f"({x(q, i)} * {y(q, i + 1)} - {x(q, i + 1)} * {y(q, i)})" for i in range(4)]
    return f"abs({' + '.join(terms)}) * 0.5D"


def _side(q: str, a: int, b: int, c: int) -> str:
    return (f"(({_x(q, b)} - {_x(q, a)}) * ({_y(q, c)} - {_y(q, a)}) - "
            f"({_y(q, b)} - {_y(q, a)}) * ({_x(q, c)} - {_x(q, a)}))")


def _edges_cross(q: str, i: int) -> str:
    """Edges i and i+2 cross."""
    a, b, c, d = i, i + 1, i + 2, i + 3
    return (f"(({_side(q, a, b, c)} > 0) <> ({_side(q, a, b, d)} > 0) AND "
            f"({_side(q, c, d, a)} > 0) <> ({_side(q, c, d, b)} > 0))")


def _tangled(q: str) -> str:
    return f"({_edges_cross(q, 0)} OR {_edges_cross(q, 1)})"


def _pair_term(a: str, i: int, b: str, j: int) -> str:
    lo = f"greatest({a}l{i}, {b}l{j})"
    hi = f"least({a}r{i}, {b}r{j})"

    def gap(x: str) -> str:
        return f"(({a}y{i} + ({x} - {a}l{i}) * {a}m{i}) - ({b}y{j} + ({x} - {b}l{j}) * {b}m{j}))"
    p, q = gap(lo), gap(hi)
    size = f"(abs({p}) + abs({q}))"
    mean = f"({size} * 0.5D - greatest(-({p} * {q}), 0D) / greatest({size}, 1E-300D))"
    return f"{a}s{i} * {b}s{j} * greatest({hi} - {lo}, 0D) * {mean}"


def overlap_area_expr(a: str, b: str) -> str:
    terms = " + ".join(_pair_term(a, i, b, j) for i in range(4) for j in range(4))
    return f"abs({terms}) * 0.5D"


def ring_overlap(a: Column, b: Column) -> Column:
    """The same sum for rings of any length, as one expression. Slow path for rare rows."""
    def edges(r: Column) -> Column:
        n = F.size(r)

        def edge(i: Column) -> Column:
            x0, y0 = F.get(r, i * 2), F.get(r, i * 2 + 1)
            x1, y1 = F.get(r, (i * 2 + 2) % n), F.get(r, (i * 2 + 3) % n)
            return F.struct(F.least(x0, x1).alias("l"), F.greatest(x0, x1).alias("r"),
                            F.when(x0 <= x1, y0).otherwise(y1).alias("y"),
                            F.coalesce(F.try_divide(y1 - y0, x1 - x0), F.lit(0.0)).alias("m"),
                            F.when(x0 < x1, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s"))
        return F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), edge)

    def term(e: Column, f: Column) -> Column:
        lo, hi = F.greatest(e["l"], f["l"]), F.least(e["r"], f["r"])

        def gap(x: Column) -> Column:
            return (e["y"] + (x - e["l"]) * e["m"]) - (f["y"] + (x - f["l"]) * f["m"])

        def area(g: Column) -> Column:
            size = F.abs(g["p"]) + F.abs(g["q"])
            mean = size * 0.5 - F.greatest(-(g["p"] * g["q"]), F.lit(0.0)) / F.greatest(size, F.lit(1e-300))
            return e["s"] * f["s"] * (hi - lo) * mean
        return F.when(hi > lo, G.let(F.struct(gap(lo).alias("p"), gap(hi).alias("q")), area)).otherwise(F.lit(0.0))

    total = F.aggregate(edges(a), F.lit(0.0), lambda s, e: s + F.aggregate(
        edges(b), F.lit(0.0), lambda t, f: t + term(e, f)))
    return F.abs(total) * 0.5


def ring_area(r: Column) -> Column:
    n = F.size(r)
    total = F.aggregate(F.sequence(F.lit(0), (n / 2).cast("int") - 1), F.lit(0.0), lambda s, i: s + (
        F.get(r, i * 2) * F.get(r, (i * 2 + 3) % n) - F.get(r, (i * 2 + 2) % n) * F.get(r, i * 2 + 1)))
    return F.abs(total) * 0.5


def _on_grid(inter: Column, union: Column) -> Column:
    exact = F.least(F.try_divide(inter, union), F.lit(1.0))
    return F.when((union <= 0) | (inter <= SNAP), F.lit(0.0)).otherwise(F.rint(exact * GRID) / GRID)


def _ratio(inter: Column, area_a: Column, area_b: Column) -> Column:
    return G.let(F.struct(inter.alias("i"), (area_a + area_b - inter).alias("u")), lambda v: _on_grid(v["i"], v["u"]))


def with_polygon_iou(df: DataFrame, pairs: Sequence[tuple[str, str, str]], order: str = "raw",
                     mode: str = "largest", valid: dict[str, str] | None = None) -> DataFrame:
    """Add one IoU column per ``(quad_a, quad_b, out)``; null when either quad is null.

    order: ``raw`` keeps the corner order; ``ccw`` sorts corners by angle first, and a quad of
    area 0 then counts as missing (null).
    mode, for self-crossing quads in raw order: ``largest`` keeps the larger piece, ``whole``
    keeps both, ``bbox_fallback`` compares bounding boxes, ``strict`` gives 0.
    valid: quad column -> name of a boolean column telling whether its polygon exists.
    """
    keep = df.columns
    quads = list(dict.fromkeys(q for a, b, _ in pairs for q in (a, b)))
    tag = {q: f"__q{n}_" for n, q in enumerate(quads)}

    names = [f"`{c}`" for c in keep]

    # 1. the ring of every quad; corners in angle order never cross
    ok = [f"`{q}` IS NOT NULL AND forall(`{q}`, c -> c IS NOT NULL) AS {tag[q]}ok" for q in quads]
    if order == "ccw":
        rings = df.selectExpr("*", *ok).withColumns({f"{tag[q]}g": G.ccw_points(F.col(q)) for q in quads})
        tangled = {q: "false" for q in quads}
        x, y = _px, _py
    else:
        flagged = df.selectExpr("*", *ok, *[f"{_tangled(q)} AS {tag[q]}x" for q in quads])
        whole = mode != "largest"
        rings = flagged.withColumns({f"{tag[q]}g": F.col(q) if whole else F.when(
            F.col(f"{tag[q]}x"), G.largest_piece(F.col(q))).otherwise(F.col(q)) for q in quads})
        tangled = {q: f"{tag[q]}x" for q in quads}
        x, y = _x, _y

    # 2. edges and areas
    def carried(q: str) -> str:
        flag = f"{tag[q]}ok"
        return f"{_alone(flag) if q == quads[0] else flag} AS {flag}"
    exprs = list(names)
    for q in quads:
        exprs += _edge_columns(f"{tag[q]}g", tag[q], x, y)
        exprs += [f"{_area(f'{tag[q]}g', x, y)} AS {tag[q]}a", f"{tangled[q]} AS {tag[q]}t", carried(q)]
    edged = rings.selectExpr(*exprs)

    # 3. overlap areas
    exprs = list(names)
    for q in quads:
        exprs += [carried(q), f"{tag[q]}a", f"{tag[q]}t"]
    exprs += [f"{overlap_area_expr(tag[a], tag[b])} AS __i{n}" for n, (a, b, _) in enumerate(pairs)]
    crossed = edged.selectExpr(*exprs).selectExpr("*", *[f"{tag[a]}a + {tag[b]}a - __i{n} AS __u{n}" for n, (a, b, _) in enumerate(pairs)])

    # 4. ratio and the special modes
    results: dict[str, Column] = {}
    for n, (a, b, name) in enumerate(pairs):
        ta, tb = tag[a], tag[b]
        area_a, area_b = F.col(f"{ta}a"), F.col(f"{tb}a")
        iou = _on_grid(F.col(f"__i{n}"), F.col(f"__u{n}"))
        ok = F.col(f"{ta}ok") & F.col(f"{tb}ok")
        mixed = F.col(f"{ta}t") | F.col(f"{tb}t")
        if order == "ccw":
            ok = ok & (area_a > 0) & (area_b > 0)
        elif mode == "strict":
            iou = F.when(mixed, F.lit(0.0)).otherwise(iou)
        elif mode == "bbox_fallback":
            iou = F.when(mixed, bbox_iou(F.col(a), F.col(b), epsilon=1e-9)).otherwise(iou)
        elif mode == "whole":
            ra, rb = G.all_pieces(F.col(a)), G.all_pieces(F.col(b))
            iou = F.when(mixed, G.let(F.struct(ra.alias("a"), rb.alias("b")), lambda r: _ratio(
                ring_overlap(r["a"], r["b"]), ring_area(r["a"]), ring_area(r["b"])))).otherwise(iou)
        results[name] = F.when(ok, iou)
    for q, name in (valid or {}).items():
        results[name] = F.col(f"{tag[q]}ok") & (F.coalesce(F.col(f"{tag[q]}a"), F.lit(0.0)) > 0)
    return computed(crossed, results, keep)


def bbox_iou(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Axis-aligned IoU of the bounding boxes; ``epsilon`` is added to the union."""
    p, q = G.bbox(a), G.bbox(b)
    w = F.greatest(F.least(p["xmax"], q["xmax"]) - F.greatest(p["xmin"], q["xmin"]), F.lit(0.0))
    h = F.greatest(F.least(p["ymax"], q["ymax"]) - F.greatest(p["ymin"], q["ymin"]), F.lit(0.0))
    inter = w * h
    union = p["area"] + q["area"] - inter + F.lit(epsilon)
    return F.when(a.isNull() | b.isNull(), None).when(union > 0, F.try_divide(inter, union)).otherwise(F.lit(0.0))
