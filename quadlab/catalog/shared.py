"""Shared pieces of the registered queries: columns on the Spark side, SQL text on the check side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadlab import fixtures as X

# ---------------------------------------------------------------- Spark side


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def num(c: Column) -> Column:
    return c.cast("int")


def spread(q: Column, prefix: str = "o", digits: int | None = None, n: int = 8) -> list[Column]:
    """The elements of an array as columns."""
    cols = [F.get(q, F.lit(i)) for i in range(n)]
    return [(c if digits is None else F.round(c, digits)).alias(f"{prefix}{i}") for i, c in enumerate(cols)]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, name, stem, gt of every labelled sample."""
    return X.labels(spark, sf).withColumnRenamed("coords", "gt")


def labelled_pairs(spark: SparkSession, sf: str, source: str = "teacher") -> DataFrame:
    """sample_id, split, name, gt, pred of every labelled sample the source detects."""
    p = X.predictions(spark, sf).where((F.col("source") == source) & (F.col("detected") == 1))
    return labelled(spark, sf).drop("stem").join(
        p.select("split", "name", F.col("coords").alias("pred"), "conf"), "name")


# ---------------------------------------------------------------- SQL side

VIEWS = ["quad_samples", "quad_predictions", "quad_images", "image_sizes", "review_events", "latency_runs",
         "train_history", "doc_hashes"]


def sel(body: str, ctes: Sequence[tuple[str, str]] = ()) -> str:
    """A query with the fixture views it mentions, then ``ctes``, in front."""
    ctes = list(ctes)
    text = " ".join([t for _, t in ctes] + [body])
    head = [(v, X.sql(v)) for v in VIEWS if v in text]
    parts = [f"{n} AS MATERIALIZED ({t})" for n, t in head + ctes]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def q6(expr: str, name: str) -> str:
    # adding zero turns a negative zero into zero
    return f"round({expr}, 6) + 0e0 AS {name}"


def cols(p: str, out: str | None = None) -> str:
    return ", ".join(f"{p}{i}" + (f" AS {out}{i}" if out else "") for i in range(8))


def shoelace(p: str) -> str:
    t = [f"{p}{2 * i} * {p}{2 * ((i + 1) % 4) + 1} - {p}{2 * ((i + 1) % 4)} * {p}{2 * i + 1}" for i in range(4)]
    return f"(abs({' + '.join(f'({x})' for x in t)}) * 0.5e0)"


def xs(p: str) -> list[str]:
    return [f"{p}{2 * i}" for i in range(4)]


def ys(p: str) -> list[str]:
    return [f"{p}{2 * i + 1}" for i in range(4)]


def box(p: str) -> dict[str, str]:
    x, y = ", ".join(xs(p)), ", ".join(ys(p))
    b = {"xmin": f"least({x})", "xmax": f"greatest({x})", "ymin": f"least({y})", "ymax": f"greatest({y})"}
    b["w"], b["h"] = f"({b['xmax']} - {b['xmin']})", f"({b['ymax']} - {b['ymin']})"
    b["area"] = f"({b['w']} * {b['h']})"
    return b


def side(p: str, a: int, b: int, c: int) -> str:
    """Which side of the line a-b corner c lies on."""
    return (f"(({p}{2*b} - {p}{2*a}) * ({p}{2*c+1} - {p}{2*a+1}) - ({p}{2*b+1} - {p}{2*a+1}) * ({p}{2*c} - {p}{2*a}))")


def crossing(p: str, a: int, b: int, c: int, d: int) -> str:
    return (f"((({side(p, a, b, c)} > 0) <> ({side(p, a, b, d)} > 0)) AND "
            f"(({side(p, c, d, a)} > 0) <> ({side(p, c, d, b)} > 0)))")


def self_crossing(p: str) -> str:
    return f"({crossing(p, 0, 1, 2, 3)} OR {crossing(p, 1, 2, 3, 0)})"


def ccw_sql(src: str, p: str, out: str, keep: str) -> str:
    """Rows of ``src`` with corners p0..p7 sorted by angle into out0..out7."""
    cx, cy = f"(({' + '.join(xs(p))}) / 4e0)", f"(({' + '.join(ys(p))}) / 4e0)"
    items = ", ".join(f"{{'a': atan2({p}{2*i+1} - {cy}, {p}{2*i} - {cx}), 'i': {i}, 'x': {p}{2*i}, 'y': {p}{2*i+1}}}"
                      for i in range(4))
    got = ", ".join(f"r[{i + 1}].x AS {out}{2*i}, r[{i + 1}].y AS {out}{2*i+1}" for i in range(4))
    return f"SELECT {keep}, {got} FROM (SELECT *, list_sort([{items}]) AS r FROM {src}) s"


def piece_sql(src: str, p: str, out: str, keep: str) -> str:
    """Rows of ``src`` with a self-crossing quad replaced by its larger triangle."""
    def cut(a: int, b: int, c: int, d: int) -> tuple[str, str]:
        t = f"({side(p, c, d, a)} / ({side(p, c, d, a)} - {side(p, c, d, b)}))"
        return (f"({p}{2*a} + {t} * ({p}{2*b} - {p}{2*a}))", f"({p}{2*a+1} + {t} * ({p}{2*b+1} - {p}{2*a+1}))")
    c1, c2 = crossing(p, 0, 1, 2, 3), crossing(p, 1, 2, 3, 0)
    x1, x2 = cut(0, 1, 2, 3), cut(1, 2, 3, 0)
    inner = (f"SELECT *, CASE WHEN {c1} THEN 1 WHEN {c2} THEN 2 ELSE 0 END AS kind, "
             f"CASE WHEN {c1} THEN {x1[0]} WHEN {c2} THEN {x2[0]} END AS kx, "
             f"CASE WHEN {c1} THEN {x1[1]} WHEN {c2} THEN {x2[1]} END AS ky FROM {src}")

    def tri_area(b: int, c: int) -> str:
        return f"abs(({p}{2*b} - kx) * ({p}{2*c+1} - ky) - ({p}{2*b+1} - ky) * ({p}{2*c} - kx))"
    pick = (f"CASE WHEN kind = 1 THEN CASE WHEN {tri_area(1, 2)} >= {tri_area(3, 0)} THEN [1, 2] ELSE [3, 0] END "
            f"WHEN kind = 2 THEN CASE WHEN {tri_area(2, 3)} >= {tri_area(0, 1)} THEN [2, 3] ELSE [0, 1] END END")
    px, py = f"[{', '.join(xs(p))}]", f"[{', '.join(ys(p))}]"

    def corner(n: int) -> str:
        if n == 0:
            return f"CASE WHEN kind = 0 THEN {p}0 ELSE kx END AS {out}0, CASE WHEN kind = 0 THEN {p}1 ELSE ky END AS {out}1"
        slot = 1 if n == 1 else 2
        return (f"CASE WHEN kind = 0 THEN {p}{2*n} ELSE {px}[pk[{slot}] + 1] END AS {out}{2*n}, "
                f"CASE WHEN kind = 0 THEN {p}{2*n+1} ELSE {py}[pk[{slot}] + 1] END AS {out}{2*n+1}")
    return (f"SELECT {keep}, {', '.join(corner(n) for n in range(4))} "
            f"FROM (SELECT *, {pick} AS pk FROM ({inner}) i) s")


def iou_ctes(out: str, src: str, order: str = "raw") -> list[tuple[str, str]]:
    """CTEs ending in ``out(pid, iou, inter, aa, ba)`` for quads a0..a7, b0..b7 of ``src(pid, ...)``.

    Independent of the Spark method: each ring becomes two signed triangles; the overlap of two triangles
    is the polygon of their mutually inside corners and edge crossings, sorted by angle.
    """
    p = f"{out}_"
    if order == "ccw":
        first = [(f"{p}a", ccw_sql(src, "a", "u", f"pid, {cols('b')}")), (f"{p}b", ccw_sql(f"{p}a", "b", "v", f"pid, {cols('u')}"))]
        first.append((f"{p}s", piece_sql(f"{p}b", "u", "s", f"pid, {cols('v')}")))
        first.append((f"{p}r", piece_sql(f"{p}s", "v", "t", f"pid, {cols('s')}")))
    else:
        first = [(f"{p}s", piece_sql(src, "a", "s", f"pid, {cols('b')}")),
                 (f"{p}r", piece_sql(f"{p}s", "b", "t", f"pid, {cols('s')}"))]

    def signed(q: str, a: int, b: int, c: int) -> str:
        return side(q, a, b, c)
    tri = ["0, 1, 2", "0, 2, 3"]

    def tri_cols(q: str, name: str, no: int) -> str:
        idx = [int(v) for v in tri[no].split(",")]
        s = signed(q, *idx)
        a, b, c = idx
        # counter-clockwise: swap the last two corners of a clockwise triangle
        return (f"{q}{2*a} AS {name}x0, {q}{2*a+1} AS {name}y0, "
                f"CASE WHEN {s} >= 0 THEN {q}{2*b} ELSE {q}{2*c} END AS {name}x1, CASE WHEN {s} >= 0 THEN {q}{2*b+1} ELSE {q}{2*c+1} END AS {name}y1, "
                f"CASE WHEN {s} >= 0 THEN {q}{2*c} ELSE {q}{2*b} END AS {name}x2, CASE WHEN {s} >= 0 THEN {q}{2*c+1} ELSE {q}{2*b+1} END AS {name}y2, "
                f"sign({s}) AS {name}sg")
    combos = " UNION ALL ".join(
        f"SELECT pid, {2*i+j} AS t, {tri_cols('s', 'a', i)}, {tri_cols('t', 'b', j)} FROM {p}r"
        for i in range(2) for j in range(2))

    def inside(q: str, x: str, y: str) -> str:
        return " AND ".join(
            f"(({q}x{(k+1)%3} - {q}x{k}) * ({y} - {q}y{k}) - ({q}y{(k+1)%3} - {q}y{k}) * ({x} - {q}x{k})) >= -1e-13"
            for k in range(3))
    items = [f"{{'ok': {inside('b', f'ax{k}', f'ay{k}')}, 'x': ax{k}, 'y': ay{k}}}" for k in range(3)]
    items += [f"{{'ok': {inside('a', f'bx{k}', f'by{k}')}, 'x': bx{k}, 'y': by{k}}}" for k in range(3)]
    for i in range(3):
        for j in range(3):
            dx, dy = f"(ax{(i+1)%3} - ax{i})", f"(ay{(i+1)%3} - ay{i})"
            ex, ey = f"(bx{(j+1)%3} - bx{j})", f"(by{(j+1)%3} - by{j})"
            den = f"({dx} * {ey} - {dy} * {ex})"
            fx, fy = f"(bx{j} - ax{i})", f"(by{j} - ay{i})"
            near = f"CASE WHEN abs({den}) > 1e-12 THEN {den} END"
            t = f"(({fx} * {ey} - {fy} * {ex}) / ({near}))"
            u = f"(({fx} * {dy} - {fy} * {dx}) / ({near}))"
            items.append(f"{{'ok': {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1, 'x': ax{i} + {t} * {dx}, 'y': ay{i} + {t} * {dy}}}")
    return first + [
        (f"{p}tt", f"SELECT * FROM ({combos}) c WHERE asg <> 0 AND bsg <> 0"),
        (f"{p}c", f"SELECT pid, t, asg * bsg AS sg, unnest([{', '.join(items)}]) AS p FROM {p}tt"),
        (f"{p}k", f"SELECT pid, t, sg, p.x AS x, p.y AS y, avg(p.x) OVER w AS cx, avg(p.y) OVER w AS cy FROM {p}c WHERE p.ok "
                  f"WINDOW w AS (PARTITION BY pid, t)"),
        (f"{p}n", f"SELECT pid, t, sg, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, "
                  f"first_value(y) OVER w AS fy FROM {p}k WINDOW w AS (PARTITION BY pid, t ORDER BY atan2(y - cy, x - cx), x, y "
                  f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
        (f"{p}g", f"SELECT pid, abs(sum(sg * ar)) AS inter FROM (SELECT pid, t, any_value(sg) AS sg, "
                  f"abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) * 0.5e0 AS ar FROM {p}n GROUP BY pid, t) z GROUP BY pid"),
        (out, f"SELECT r.pid, CASE WHEN aa + ba - i <= 0 OR i <= 1e-14 THEN 0e0 ELSE least(i / (aa + ba - i), 1e0) END AS iou, "
              f"i AS inter, aa, ba FROM (SELECT r.pid, coalesce(g.inter, 0e0) AS i, {shoelace('s')} AS aa, {shoelace('t')} AS ba "
              f"FROM {p}r r LEFT JOIN {p}g g ON r.pid = g.pid) r"),
    ]


def pairs_cte(source: str = "teacher", name: str = "pr") -> tuple[str, str]:
    """pid, split, name, a0..a7 (prediction), b0..b7 (label) of labelled, detected samples."""
    a = ", ".join(f"p.c{i} AS a{i}" for i in range(8))
    b = ", ".join(f"s.g{i} AS b{i}" for i in range(8))
    return (name, f"SELECT s.sample_id AS pid, s.split, s.name, p.conf, {a}, {b} FROM quad_samples s "
                  f"JOIN quad_predictions p ON s.sample_id = p.sample_id WHERE p.source = '{source}' AND p.detected = 1 "
                  f"AND s.g0 IS NOT NULL")


def corner_err(a: str, b: str, w: str = "224e0", h: str | None = None) -> list[str]:
    h = h or w
    return [f"sqrt(power(({a}{2*i} - {b}{2*i}) * {w}, 2) + power(({a}{2*i+1} - {b}{2*i+1}) * {h}, 2))" for i in range(4)]


def evaluated_ctes(source: str = "teacher", name: str = "ev") -> list[tuple[str, str]]:
    """``name(sample_id, split, name, has_doc, is_negative, score, iou, err_mean, err_max, e0..e3, g0.., c0..)``
    of every sample; undetected predictions are the zero quad."""
    c = ", ".join(f"CASE WHEN p.detected = 1 THEN p.c{i} ELSE 0e0 END AS c{i}" for i in range(8))
    g = ", ".join(f"s.g{i}" for i in range(8))
    e = ", ".join(f"{x} AS e{i}" for i, x in enumerate(corner_err("c", "g")))
    rows = (f"SELECT s.sample_id, s.split, s.name, s.g0 IS NOT NULL AS has_doc, starts_with(s.name, 'negative_') AS is_negative, "
            f"coalesce(p.conf * p.detected, 0e0) AS score, coalesce(p.detected, 0) AS detected, {g}, {c} FROM quad_samples s "
            f"LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id AND p.source = '{source}'")
    return [(f"{name}_x", rows), pairs_cte(source, f"{name}_p"), *iou_ctes(f"{name}_i", f"{name}_p"),
            (name, f"SELECT x.*, CASE WHEN has_doc THEN coalesce(i.iou, 0e0) END AS iou, (e0 + e1 + e2 + e3) / 4e0 AS err_mean, "
                   f"greatest(e0, e1, e2, e3) AS err_max FROM (SELECT *, {e} FROM {name}_x) x LEFT JOIN {name}_i i ON x.sample_id = i.pid")]


def audit_ctes(source: str = "teacher") -> list[tuple[str, str]]:
    """``au``: the teacher audit table, one row per sample."""
    def rotations() -> str:
        out = []
        for r in range(4):
            e = [f"sqrt(power((g{2*((i+r)%4)} - c{2*i}) * w, 2) + power((g{2*((i+r)%4)+1} - c{2*i+1}) * h, 2))" for i in range(4)]
            out.append(f"{{'t': {' + '.join(e)}, 'r': {r}, 'm': greatest({', '.join(e)})}}")
        return f"list_sort([{', '.join(out)}])[1]"
    c = ", ".join(f"CASE WHEN p.detected = 1 THEN p.c{i} END AS c{i}" for i in range(8))
    g = ", ".join(f"CASE WHEN z.w IS NOT NULL THEN s.g{i} END AS g{i}" for i in range(8))
    oob = " OR ".join(f"g{i} < -0.02 OR g{i} > 1.02" for i in range(8))
    return [
        ("au_x", f"SELECT s.sample_id, s.split, s.name, starts_with(s.name, 'negative_') AS is_negative, z.w, z.h, "
                 f"CASE WHEN z.w IS NULL THEN 0 ELSE coalesce(p.detected, 0) END AS detected, "
                 f"CASE WHEN z.w IS NULL THEN 0e0 ELSE coalesce(p.conf, 0e0) END AS conf, s.g0 IS NOT NULL AS label_exists, "
                 f"{g}, {c} FROM quad_samples s LEFT JOIN image_sizes z ON s.sample_id = z.sample_id "
                 f"LEFT JOIN quad_predictions p ON s.sample_id = p.sample_id AND p.source = '{source}'"),
        pairs_cte(source, "au_p"), *iou_ctes("au_i", "au_p"),
        ("au_v", piece_sql("(SELECT * FROM au_x WHERE g0 IS NOT NULL)", "g", "v", "sample_id")),
        ("au", f"SELECT x.* EXCLUDE (rot0), x.g0 IS NOT NULL AS gt_valid, x.w IS NOT NULL AS image_exists, coalesce({oob}, false) AS gt_oob, "
               f"{shoelace('v')} * w * h / greatest(1e0, w * h) AS gt_area_ratio, "
               f"CASE WHEN x.g0 IS NOT NULL AND x.detected = 1 THEN i.iou END AS iou, "
               f"CASE WHEN x.g0 IS NOT NULL AND x.detected = 1 THEN rot0 END AS rot "
               f"FROM (SELECT *, {rotations()} AS rot0 FROM au_x) x LEFT JOIN au_v v ON x.sample_id = v.sample_id "
               f"LEFT JOIN au_i i ON x.sample_id = i.pid"),
    ]
