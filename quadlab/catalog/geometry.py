"""GEO-*: geometry of one quad."""

from pyspark.sql import functions as F

from quadlab import fixtures as X
from quadlab.catalog import query
from quadlab.catalog.shared import (
    box, ccw_sql, cols, labelled, num, piece_sql, q6, r6, sel, self_crossing, shoelace, side, spread, xs, ys)
from quadlab.functions import geometry as G


def gt():
    return F.col("gt")


LAB = "(SELECT * FROM quad_samples WHERE g0 IS NOT NULL)"
B = box("g")


@query("geo_01_clip01", sel("SELECT sample_id, " + ", ".join(
    f"CASE WHEN g{i} > 1 THEN 1e0 WHEN g{i} < 0 THEN 0e0 ELSE g{i} END AS o{i}" for i in range(8)) + f" FROM {LAB} s"))
def clip01(spark, sf):
    return labelled(spark, sf).select("sample_id", *spread(G.clip01(gt())))


@query("geo_02_order_ccw", sel(ccw_sql(LAB, "g", "o", "sample_id")))
def order_ccw(spark, sf):
    return labelled(spark, sf).select("sample_id", *spread(G.order_ccw(gt())))


def _angle_sql() -> str:
    pt = [f"{{'x': o{2*i}, 'y': o{2*i+1}}}" for i in range(4)]
    start = f"list_position([{', '.join(f'o{2*i} + o{2*i+1}' for i in range(4))}], least({', '.join(f'o{2*i} + o{2*i+1}' for i in range(4))}))"
    roll = f"SELECT sample_id, [{', '.join(pt + pt)}][{start}:{start} + 3] AS r FROM (SELECT * FROM o) z"
    out = ", ".join(
        f"CASE WHEN r[2].y > r[4].y THEN r[{[1, 4, 3, 2][i]}].{c} ELSE r[{i + 1}].{c} END AS o{2*i + n}"
        for i in range(4) for n, c in enumerate("xy"))
    return f"SELECT sample_id, {out} FROM ({roll}) y"


@query("geo_03_order_tlbr_angle", sel(_angle_sql(), [("o", ccw_sql("(" + X.sql("quad_samples") + " WHERE k % 10 < 8 AND k % 101 <> 0)", "g", "o", "sample_id"))]))
def order_tlbr_angle(spark, sf):
    return labelled(spark, sf).select("sample_id", *spread(G.order_tlbr_angle(gt())))


def _pick(key: list[str], fn: str, axis: int) -> str:
    return f"[{', '.join(f'g{2*i + axis}' for i in range(4))}][list_position([{', '.join(key)}], {fn}({', '.join(key)}))]"


def _sumdiff_sql() -> str:
    s = [f"{x} + {y}" for x, y in zip(xs("g"), ys("g"))]
    d = [f"{y} - {x}" for x, y in zip(xs("g"), ys("g"))]
    plan = [(s, "least"), (d, "least"), (s, "greatest"), (d, "greatest")]
    return "SELECT sample_id, " + ", ".join(
        f"{_pick(k, f, a)} AS o{2*i + a}" for i, (k, f) in enumerate(plan) for a in (0, 1)) + f" FROM {LAB} s"


@query("geo_04_order_tlbr_sumdiff", sel(_sumdiff_sql()))
def order_tlbr_sumdiff(spark, sf):
    return labelled(spark, sf).select("sample_id", *spread(G.order_tlbr_sumdiff(gt())))


def _rows_sql() -> str:
    pts = f"SELECT sample_id, unnest([{', '.join(f'{{i: {i}, x: g{2*i}, y: g{2*i+1}}}' for i in range(4))}]) AS p FROM {LAB} s"
    ranked = (f"SELECT sample_id, p.i AS i, p.x AS x, p.y AS y, row_number() OVER (PARTITION BY sample_id ORDER BY p.y, p.i) AS rk FROM ({pts}) a")
    slot = (f"SELECT sample_id, x, y, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN rk <= 2 THEN 0 ELSE 1 END, "
            f"CASE WHEN rk <= 2 THEN x ELSE -x END, rk) AS n FROM ({ranked}) b")
    return "SELECT sample_id, " + ", ".join(
        f"max(CASE WHEN n = {i + 1} THEN {c} END) AS o{2*i + a}" for i in range(4) for a, c in enumerate("xy")) + \
        f" FROM ({slot}) c GROUP BY sample_id"


@query("geo_05_order_tlbr_rows", sel(_rows_sql()))
def order_tlbr_rows(spark, sf):
    return labelled(spark, sf).select("sample_id", *spread(G.order_tlbr_rows(gt())))


@query("geo_06_shoelace_area", sel(f"SELECT sample_id, {shoelace('g')} AS area FROM {LAB} s"))
def shoelace_area(spark, sf):
    return labelled(spark, sf).select("sample_id", G.shoelace_area(gt()).alias("area"))


@query("geo_07_valid_area", sel(
    f"SELECT v.sample_id, {q6(shoelace('v'), 'area')}, {q6(shoelace('v') + ' * w * h / greatest(1e0, w * h)', 'area_ratio')} "
    f"FROM v JOIN image_sizes z ON v.sample_id = z.sample_id", [("v", piece_sql(
        "(" + X.sql("quad_samples") + " WHERE k % 10 < 8 AND k % 101 <> 0)", "g", "v", "sample_id"))]))
def valid_area(spark, sf):
    rows = labelled(spark, sf).join(X.sizes(spark, sf).select("name", "w", "h"), "name")
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    px = G.valid_area(G.to_px(gt(), w, h))
    return rows.select("sample_id", r6(G.valid_area(gt()), "area"), r6(px / F.greatest(F.lit(1.0), w * h), "area_ratio"))


@query("geo_08_bbox", sel("SELECT sample_id, " + ", ".join(f"{e} AS {n}" for n, e in B.items())
                          + f", least({B['w']}, {B['h']}) AS min_dim FROM {LAB} s"))
def bbox(spark, sf):
    return labelled(spark, sf).select("sample_id", *[c.alias(n) for n, c in G.bbox(gt()).items()])


@query("geo_09_border_margin", sel(
    f"SELECT s.sample_id, least({B['xmin']}, {B['ymin']}, 1 - {B['xmax']}, 1 - {B['ymax']}) AS margin, CASE WHEN w IS NOT NULL THEN "
    f"least({B['xmin']} * w, {B['ymin']} * h, (1 - {B['xmax']}) * w, (1 - {B['ymax']}) * h) END AS margin_px "
    f"FROM {LAB} s LEFT JOIN image_sizes z ON s.sample_id = z.sample_id"))
def border_margin(spark, sf):
    rows = labelled(spark, sf).join(X.sizes(spark, sf).select("name", "w", "h"), "name", "left")
    return rows.select("sample_id", G.border_margin(gt()).alias("margin"),
                       G.border_margin_px(gt(), F.col("w").cast("double"), F.col("h").cast("double")).alias("margin_px"))


def _edges(p: str) -> list[str]:
    return [f"sqrt(power({p}{2*((i+1)%4)} - {p}{2*i}, 2) + power({p}{2*((i+1)%4)+1} - {p}{2*i+1}, 2))" for i in range(4)]


E = _edges("g")


@query("geo_10_edge_ratio", sel(
    f"SELECT sample_id, {', '.join(q6(e, f'e{i}') for i, e in enumerate(E))}, CASE WHEN least({', '.join(E)}) > 1e-9 "
    f"THEN round(greatest({', '.join(E)}) / least({', '.join(E)}), 6) ELSE 1e308 END AS ratio FROM {LAB} s"))
def edge_ratio(spark, sf):
    ratio = F.round(G.edge_ratio(gt()), 6)
    return labelled(spark, sf).select("sample_id", *[r6(e, f"e{i}") for i, e in enumerate(G.edge_lengths(gt()))],
                                      F.least(ratio, F.lit(1e308)).alias("ratio"))


def angle_sql(p: str) -> list[str]:
    """Angles through atan2 of cross and dot product, another route than acos."""
    out = []
    for i in range(4):
        a, b = (i - 1) % 4, (i + 1) % 4
        ax, ay, bx, by = f"({p}{2*a} - {p}{2*i})", f"({p}{2*a+1} - {p}{2*i+1})", f"({p}{2*b} - {p}{2*i})", f"({p}{2*b+1} - {p}{2*i+1})"
        flat = f"sqrt({ax}*{ax} + {ay}*{ay}) <= 1e-9 OR sqrt({bx}*{bx} + {by}*{by}) <= 1e-9"
        out.append(f"(CASE WHEN {flat} THEN 0e0 ELSE degrees(abs(atan2({ax} * {by} - {ay} * {bx}, {ax} * {bx} + {ay} * {by}))) END)")
    return out


A = angle_sql("g")


@query("geo_11_interior_angles", sel(
    f"SELECT sample_id, {', '.join(f'round({a}, 4) + 0e0 AS a{i}' for i, a in enumerate(A))}, "
    f"round(least({', '.join(A)}), 4) + 0e0 AS amin, round(greatest({', '.join(A)}), 4) + 0e0 AS amax FROM {LAB} s"))
def interior_angles(spark, sf):
    a = G.interior_angles(gt())
    return labelled(spark, sf).select(
        "sample_id", *[F.round(v, 4).alias(f"a{i}") for i, v in enumerate(a)],
        F.round(F.least(*a), 4).alias("amin"), F.round(F.greatest(*a), 4).alias("amax"))


def turns(p: str) -> list[str]:
    return [side(p, i, (i + 1) % 4, (i + 2) % 4) for i in range(4)]


def convex_sql(p: str) -> str:
    t = ", ".join(f"CASE WHEN abs({x}) > 1e-12 THEN {x} END" for x in turns(p))
    return f"coalesce(least({t}) > 0 OR greatest({t}) < 0, true)"


STRICT = " + ".join(f"CAST({x} > 0 AS INT)" for x in turns("g"))


@query("geo_12_is_convex", sel(
    f"SELECT sample_id, CAST({convex_sql('o')} AS INT) AS convex, CAST(({STRICT}) IN (0, 4) AS INT) AS convex_strict FROM o",
    [("o", ccw_sql("(" + X.sql("quad_samples") + " WHERE k % 10 < 8 AND k % 101 <> 0)", "g", "o", f"sample_id, {cols('g')}"))]))
def is_convex(spark, sf):
    return labelled(spark, sf).withColumn("o", G.order_ccw(gt())).select(
        "sample_id", num(G.is_convex(F.col("o"))).alias("convex"), num(G.is_convex_strict(gt())).alias("convex_strict"))


@query("geo_13_is_self_intersecting", sel(
    f"SELECT sample_id, CAST({self_crossing('g')} AS INT) AS crossing, "
    f"CAST({B['area']} > 0.01 AND {shoelace('g')} / {B['area']} < 0.3 AS INT) AS cheap FROM {LAB} s"))
def is_self_intersecting(spark, sf):
    b = G.bbox(gt())["area"]
    return labelled(spark, sf).select("sample_id", num(G.is_self_intersecting(gt())).alias("crossing"),
                                      num((b > 0.01) & (F.try_divide(G.shoelace_area(gt()), b) < 0.3)).alias("cheap"))


@query("geo_14_fill_ratio", sel(
    f"SELECT sample_id, {q6('CASE WHEN ' + box('o')['area'] + ' > 1e-9 THEN ' + shoelace('o') + ' / ' + box('o')['area'] + ' ELSE 0e0 END', 'fill')} FROM o",
    [("o", ccw_sql("(" + X.sql("quad_samples") + " WHERE k % 10 < 8 AND k % 101 <> 0)", "g", "o", "sample_id"))]))
def fill_ratio(spark, sf):
    return labelled(spark, sf).withColumn("o", G.order_ccw(gt())).select("sample_id", r6(G.fill_ratio(F.col("o")), "fill"))


def issue_rows(tests: list[tuple[str, str]], src: str, key: str = "sample_id") -> str:
    """One row per issue text that applies."""
    items = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in tests)
    return f"SELECT {key}, i AS issue FROM (SELECT {key}, unnest([{items}]) AS i FROM {src} s) z WHERE i IS NOT NULL"


CORNER_TESTS = [("g1 > g7 + 0.1", "'TL_below_BL'"), ("g3 > g5 + 0.1", "'TR_below_BR'"),
                ("g0 > g2 + 0.1", "'TL_right_of_TR'"), ("g6 > g4 + 0.1", "'BL_right_of_BR'")]
TOUCH_TESTS = [(f"{B['xmin']} < 0.02", f"printf('touches_left_edge:%.3f', {B['xmin']})"),
               (f"{B['xmax']} > 0.98", f"printf('touches_right_edge:%.3f', {B['xmax']})"),
               (f"{B['ymin']} < 0.02", f"printf('touches_top_edge:%.3f', {B['ymin']})"),
               (f"{B['ymax']} > 0.98", f"printf('touches_bottom_edge:%.3f', {B['ymax']})")]


@query("geo_15_corner_order_issues", sel(issue_rows(CORNER_TESTS, LAB)))
def corner_order_issues(spark, sf):
    return labelled(spark, sf).select("sample_id", F.explode(G.corner_order_issues(gt())).alias("issue"))


@query("geo_16_edge_touch_issues", sel(issue_rows(TOUCH_TESTS, LAB)))
def edge_touch_issues(spark, sf):
    return labelled(spark, sf).select("sample_id", F.explode(G.edge_touch_issues(gt())).alias("issue"))


LO, HI = f"least({', '.join(E)})", f"greatest({', '.join(E)})"
AMIN, AMAX = f"least({', '.join(A)})", f"greatest({', '.join(A)})"
QUAD_TESTS = [
    (f"{B['xmin']} < -0.01 OR {B['xmax']} > 1.01 OR {B['ymin']} < -0.01 OR {B['ymax']} > 1.01",
     f"printf('coords_outside_bounds: x=[%.3f,%.3f] y=[%.3f,%.3f]', {B['xmin']}, {B['xmax']}, {B['ymin']}, {B['ymax']})"),
    (f"{shoelace('g')} > 0.95", f"printf('very_large_bbox: area=%.3f', {shoelace('g')})"),
    (f"greatest({B['w']} / {B['h']}, {B['h']} / {B['w']}) > 5", f"printf('extreme_aspect_ratio: %.1f', greatest({B['w']} / {B['h']}, {B['h']} / {B['w']}))"),
    (f"{LO} < 0.02", f"printf('very_short_edge: %.4f', {LO})"),
    (f"{LO} > 0 AND {HI} / {LO} > 10", f"printf('edge_ratio_extreme: %.1f', {HI} / {LO})"),
    (f"{AMIN} < 20", f"printf('very_acute_angle: %.1f°', {AMIN})"),
    (f"{AMAX} > 160", f"printf('very_obtuse_angle: %.1f°', {AMAX})"),
    (f"({STRICT}) NOT IN (0, 4)", "'non_convex_quad'"),
    (f"{B['area']} > 0.01 AND {shoelace('g')} / {B['area']} < 0.3",
     f"printf('possibly_self_intersecting: area_ratio=%.2f', {shoelace('g')} / {B['area']})"),
]


@query("geo_17_quad_issues", sel(issue_rows(QUAD_TESTS, LAB)))
def quad_issues(spark, sf):
    return labelled(spark, sf).select("sample_id", F.explode(G.quad_issues(gt())).alias("issue"))


def sane_sql(p: str) -> str:
    b = box(p)
    return (f"({b['xmin']} >= -0.05 AND {b['ymin']} >= -0.05 AND {b['xmax']} <= 1.05 AND {b['ymax']} <= 1.05 AND "
            f"{shoelace(p)} >= 1e-4 AND {b['w']} >= 1e-3 AND {b['h']} >= 1e-3)")


@query("geo_18_quad_is_sane", sel(f"SELECT sample_id, CAST(coalesce({sane_sql('g')}, false) AS INT) AS sane FROM quad_samples"))
def quad_is_sane(spark, sf):
    rows = X.samples(spark, sf).join(X.labels(spark, sf).select("stem", "coords"), "stem", "left")
    return rows.select("sample_id", num(G.quad_is_sane(F.col("coords"))).alias("sane"))


@query("geo_19_out_of_bounds", sel(
    f"SELECT sample_id, CAST({B['xmin']} < -0.02 OR {B['ymin']} < -0.02 OR {B['xmax']} > 1.02 OR {B['ymax']} > 1.02 AS INT) AS oob FROM {LAB} s"))
def out_of_bounds(spark, sf):
    return labelled(spark, sf).select("sample_id", num(G.out_of_bounds(gt(), 0.02)).alias("oob"))


@query("geo_20_px_norm", sel(
    "SELECT s.sample_id, " + ", ".join(f"g{i} * {'wh'[i % 2]} AS p{i}" for i in range(8)) + ", " + ", ".join(
        f"round(least(greatest(least(greatest(g{i} * {'wh'[i % 2]}, 0), {'wh'[i % 2]} - 1) / {'wh'[i % 2]}, 0), 1), 6) AS n{i}" for i in range(8))
    + f" FROM {LAB} s JOIN image_sizes z ON s.sample_id = z.sample_id"))
def px_norm(spark, sf):
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    rows = labelled(spark, sf).join(X.sizes(spark, sf).select("name", "w", "h"), "name").withColumn("px", G.to_px(gt(), w, h))
    return rows.select("sample_id", *spread(F.col("px"), "p"), *spread(G.to_norm(F.col("px"), w, h, clip_inside=True), "n", 6))


def _augment_sql() -> str:
    c, s = "cos(radians(-a))", "sin(radians(-a))"
    rot = ", ".join(
        f"((g{2*i} - 0.5e0) * {c} - (g{2*i+1} - 0.5e0) * {s}) + 0.5e0 AS r{2*i}, "
        f"((g{2*i} - 0.5e0) * {s} + (g{2*i+1} - 0.5e0) * {c}) + 0.5e0 AS r{2*i+1}" for i in range(4))
    scaled = ", ".join(f"0.5e0 + (r{i} - 0.5e0) * f AS s{i}" for i in range(8))
    flip = ", ".join(f"{q6(f'1 - s{2*j}', f'o{2*i}')}, {q6(f's{2*j+1}', f'o{2*i+1}')}" for i, j in enumerate((1, 0, 3, 2)))
    src = (f"SELECT s.*, v, CAST(v * 5 - 10 AS DOUBLE) AS a, 0.8e0 + v * 0.1e0 AS f FROM {LAB} s CROSS JOIN "
           f"(SELECT unnest([1, 2, 3]) AS v) n")
    return (f"SELECT sample_id, v, {flip} FROM (SELECT sample_id, v, {scaled} FROM (SELECT sample_id, v, f, {rot} FROM ({src}) a) b) c")


@query("geo_21_augment", sel(_augment_sql()))
def augment(spark, sf):
    """Three variants of each label: rotated, scaled about the centre, then mirrored."""
    v = F.col("v")
    rows = labelled(spark, sf).withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(3))))
    rows = rows.withColumn("r", G.rotate(gt(), (v * 5 - 10).cast("double")))
    rows = rows.withColumn("s", G.scale_about_centre(F.col("r"), F.lit(0.8) + v * F.lit(0.1)))
    return rows.select("sample_id", "v", *spread(G.hflip(F.col("s")), "o", 6))
