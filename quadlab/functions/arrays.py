"""Decoders and signals over numeric arrays held in columns.

Grids are flat ``array<double>`` in row order with a known width.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quadlab.functions.geometry import clamp, fixed, let


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(logit, -60.0, 60.0)))


def dequantize(q: Column, scale: Column, zero: Column) -> Column:
    return F.transform(q, lambda v: (v.cast("double") - zero) * scale)


def expected_bin(logits: Column, tau: float = 1.0) -> Column:
    """Softmax over the bins, then the expected bin centre in [0,1]."""
    def weights(scaled: Column) -> Column:
        return let(F.array_max(scaled), lambda top: F.transform(scaled, lambda v: F.exp(v - top)))

    def expect(w: Column) -> Column:
        norm = _total(w) + 1e-8
        last = F.greatest(F.size(w) - 1, F.lit(1)).cast("double")
        mass = F.aggregate(F.transform(w, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
        return clamp(mass / (norm * last))
    return let(F.transform(logits, lambda v: v / F.lit(tau)), lambda s: let(weights(s), expect))


def decode_bins(x: Column, y: Column, tau: float = 1.0) -> Column:
    """``x``, ``y``: 4 arrays of logits each. Eight coordinates x0,y0,...,x3,y3."""
    return F.flatten(F.zip_with(x, y, lambda a, b: F.array(expected_bin(a, tau), expected_bin(b, tau))))


def decode_bins_packed(xy: Column, tau: float = 1.0, bins_first: bool = False) -> Column:
    """One array of 8 logit rows (4 x, then 4 y), or of bins with 8 values each."""
    if bins_first:
        bins = xy
        xy = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.transform(bins, lambda b: F.get(b, c)))
    return decode_bins(F.slice(xy, 1, 4), F.slice(xy, 5, 4), tau)


def heat_soft(cell: Column, width: int, height: int) -> Column:
    """Mass-weighted mean position of one channel, as array(x, y) in [0,1]."""
    def decode(c: Column) -> Column:
        norm = _total(c) + 1e-9
        mx = _total(F.transform(c, lambda v, i: v * (i % width)))
        my = _total(F.transform(c, lambda v, i: v * F.floor(i / width)))
        return F.array(clamp(mx / norm / F.lit(float(max(width - 1, 1)))),
                       clamp(my / norm / F.lit(float(max(height - 1, 1)))))
    return let(cell, decode)


def heat_argmax(cell: Column, width: int, height: int) -> Column:
    """Position of the first greatest cell."""
    def decode(i: Column) -> Column:
        return F.array((i % width) / F.lit(float(max(width - 1, 1))),
                       F.floor(i / width) / F.lit(float(max(height - 1, 1))))
    return let((F.array_position(cell, F.array_max(cell)) - 1).cast("int"), decode)


def heat_centroid(cell: Column, width: int, height: int, threshold: float, w: Column, h: Column) -> Column:
    """Weighted centroid of the cells at or above ``threshold`` in an image of w x h: struct(ok, peak, x, y)."""
    def decode(c: Column) -> Column:
        used = F.transform(c, lambda v: F.when(v >= threshold, v).otherwise(F.lit(0.0)))

        def place(u: Column) -> Column:
            mass = _total(u)
            gx = F.try_divide(_total(F.transform(u, lambda v, i: v * (i % width))), mass)
            gy = F.try_divide(_total(F.transform(u, lambda v, i: v * F.floor(i / width))), mass)
            px = gx / F.lit(max(1.0, width - 1.0)) * F.greatest(F.lit(1.0), w - 1.0)
            py = gy / F.lit(max(1.0, height - 1.0)) * F.greatest(F.lit(1.0), h - 1.0)
            ok = (F.array_max(c) >= threshold) & (mass > 0)
            return F.struct(ok.alias("ok"), F.array_max(c).alias("peak"),
                            F.when(ok, clamp(px / w)).otherwise(F.lit(-1.0)).alias("x"),
                            F.when(ok, clamp(py / h)).otherwise(F.lit(-1.0)).alias("y"))
        return let(used, place)
    return let(cell, decode)


def decode_heat_soft(heat: Column, width: int, height: int) -> Column:
    return F.flatten(F.transform(heat, lambda c: heat_soft(c, width, height)))


def decode_heat_argmax(heat: Column, width: int, height: int) -> Column:
    return F.flatten(F.transform(heat, lambda c: heat_argmax(c, width, height)))


def decode_heat_centroid(heat: Column, width: int, height: int, threshold: float, w: Column, h: Column) -> Column:
    """struct(detected, conf, coords): undetected when any channel stays below the threshold."""
    def join(ch: Column) -> Column:
        ok = F.forall(ch, lambda c: c["ok"])
        peak = _total(F.transform(ch, lambda c: c["peak"])) / F.size(ch)
        pts = F.flatten(F.transform(ch, lambda c: F.array(c["x"], c["y"])))
        return F.struct(ok.cast("int").alias("detected"),
                        F.when(ok, clamp(peak)).otherwise(F.lit(0.0)).alias("conf"),
                        F.when(ok, pts).otherwise(F.array_repeat(F.lit(-1.0), 8)).alias("coords"))
    return let(F.transform(heat, lambda c: heat_centroid(c, width, height, threshold, w, h)), join)


def difference_hash(grid: Column, width: int) -> Column:
    """Per row, one bit per neighbouring pair: left greater than right."""
    bits = F.transform(grid, lambda v, i: F.when(
        (i % width) < width - 1, F.when(v > F.get(grid, i + 1), F.lit("1")).otherwise(F.lit("0"))).otherwise(F.lit("")))
    return F.array_join(bits, "")


def grid_stats(grid: Column, width: int) -> Column:
    """struct(mean, std, edge_var): brightness, contrast and variance of the inner Laplacian edge response."""
    def variance(a: Column) -> Column:
        return let(_total(a) / F.size(a), lambda m: _total(F.transform(a, lambda v: (v - m) * (v - m))) / F.size(a))

    def edges(g: Column) -> Column:
        rows = (F.size(g) / width).cast("int")
        inner = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (
            (i % width > 0) & (i % width < width - 1) & (F.floor(i / width) > 0) & (F.floor(i / width) < rows - 1)))
        around = [-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1]
        return F.transform(inner, lambda i: F.get(g, i) * 8.0 - sum((F.get(g, i + d) for d in around), F.lit(0.0)))

    return F.struct((_total(grid) / F.size(grid)).alias("mean"), F.sqrt(variance(grid)).alias("std"),
                    variance(edges(grid)).alias("edge_var"))


def image_quality_issues(w: Column, h: Column, brightness: Column, contrast: Column, edge_var: Column) -> Column:
    aspect = F.greatest(w / h, h / w)
    level = (F.when(brightness < 30, fixed("very_dark:brightness=%.1f", brightness))
             .when(brightness < 50, fixed("dark:brightness=%.1f", brightness))
             .when(brightness > 240, fixed("very_bright:brightness=%.1f", brightness))
             .when(brightness > 220, fixed("bright:brightness=%.1f", brightness)))
    return F.array_compact(F.array(
        F.when((w < 200) | (h < 200), F.format_string("low_resolution:%dx%d", w.cast("int"), h.cast("int"))),
        level,
        F.when(contrast < 20, fixed("low_contrast:stddev=%.1f", contrast)),
        F.when(edge_var < 100, fixed("possibly_blurry:variance=%.1f", edge_var)),
        F.when(aspect > 3, fixed("unusual_image_aspect:%.1f", aspect)),
    ))
