"""Operators on pixel tables ``image_id, y, x, v`` (or b, g, r)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from furrow.functions.geometry import inside_region

# Grey level that counts as foreground when overlaying, and as non-black.
OVERLAY_LEVEL = 10
BLACK_LEVEL = 1


def in_mask(pixels: DataFrame, corners, width: int, height: int) -> DataFrame:
    return pixels.where(inside_region(F.col("x"), F.col("y"), corners, width, height))


def perspective(source: Sequence, target: Sequence) -> list[float]:
    """3 x 3 transform through four point pairs (one 8 x 8 solve)."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]


def region_cells(matrix: Sequence[Sequence[int]], corners) -> list[list[tuple[int, int]]]:
    """Corners of every marked cell of a grid stretched over the plot."""
    rows, cols = len(matrix), len(matrix[0])
    h = perspective([(0, 0), (cols, 0), (0, rows), (cols, rows)], corners)

    def move(x: int, y: int) -> tuple[int, int]:
        w = h[6] * x + h[7] * y + h[8]
        # the solve leaves 1e-15 noise that must not push an exact integer below itself
        return int(round((h[0] * x + h[1] * y + h[2]) / w, 6)), int(round((h[3] * x + h[4] * y + h[5]) / w, 6))

    return [
        [move(x, y), move(x + 1, y), move(x, y + 1), move(x + 1, y + 1)]
        for y in range(rows)
        for x in range(cols)
        if matrix[y][x] == 1
    ]


def in_region_matrix(pixels: DataFrame, matrix, corners, width: int, height: int) -> DataFrame:
    """Pixels strictly inside any marked cell."""
    hit: Column = F.lit(False)
    for cell in region_cells(matrix, corners):
        hit = hit | inside_region(F.col("x"), F.col("y"), cell, width, height)
    return pixels.where(hit)


def crop(pixels: DataFrame, x0, x1, y0, y1) -> DataFrame:
    """Half-open crop; bounds are numbers or columns."""
    return pixels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def content_box(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Bounding box of the non-black pixels per image (inclusive)."""
    seen = pixels.where(F.col(value) > BLACK_LEVEL)
    return seen.groupBy("image_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


def crop_black(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Cuts each image to rows ``y0 .. y1 + 1`` and columns ``x0 .. x1 - 1`` of its box:
    one row more and one column less than the box, as the stitching step does."""
    boxed = pixels.join(content_box(pixels, value), "image_id")
    inside = F.col("x").between(F.col("x0"), F.col("x1") - 1) & F.col("y").between(F.col("y0"), F.col("y1") + 1)
    return boxed.where(inside).drop("x0", "x1", "y0", "y1")


def overlay(background: DataFrame, foreground: DataFrame, value: str = "v") -> DataFrame:
    """Foreground pixel where it is brighter than the level, else the background."""
    front = foreground.select("image_id", "y", "x", F.col(value).alias("_front"))
    merged = F.when(F.col("_front") > OVERLAY_LEVEL, F.col("_front")).otherwise(F.col(value))
    return background.join(front, ["image_id", "y", "x"], "left").withColumn(value, merged).drop("_front")


def lens_source(x: Column, y: Column, width: int, height: int, strength: float, zoom: float = 1.0) -> tuple[Column, Column]:
    """Source pixel (truncated) of an output pixel under radial correction."""
    cx, cy = width / 2, height / 2
    radius = math.hypot(width, height) / (strength or 0.0001)
    dx, dy = x - cx, y - cy
    r = F.sqrt(dx * dx + dy * dy) / radius
    theta = F.when(r == 0, F.lit(1.0)).otherwise(F.atan(r) / F.nullif(r, F.lit(0.0)))
    return (theta * dx * zoom + cx).cast("int"), (theta * dy * zoom + cy).cast("int")


def fix_distortion(pixels: DataFrame, width: int, height: int, strength: float = 0.5, zoom: float = 1.0) -> DataFrame:
    """Radial lens correction as an equi join on the source pixel."""
    sx, sy = lens_source(F.col("x"), F.col("y"), width, height, strength, zoom)
    wanted = pixels.select("image_id", "y", "x", sx.alias("_sx"), sy.alias("_sy"))
    source = pixels.select("image_id", F.col("y").alias("_sy"), F.col("x").alias("_sx"), "v")
    return wanted.join(source, ["image_id", "_sy", "_sx"]).select("image_id", "y", "x", "v")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    return [w / total for w in weights]


# 5-tap binomial kernel used for the blur before the Otsu threshold.
SMOOTH_KERNEL = (0.0625, 0.25, 0.375, 0.25, 0.0625)


def filter_lines(lines: np.ndarray, kernel: Sequence[float], repeat_edge: bool = True) -> np.ndarray:
    """Symmetric filter along the last axis; positions outside mirror back into the line,
    with the edge value repeated (``c b a | a b c``) or not (``c b | a b c``)."""
    size, radius = lines.shape[-1], len(kernel) // 2
    period = 2 * size if repeat_edge else max(2 * size - 2, 1)
    place = np.arange(-radius, size + radius) % period
    padded = lines[..., np.where(place < size, place, (period - 1 if repeat_edge else period) - place)]
    return sum(w * padded[..., k : k + size] for k, w in enumerate(kernel))


def _line_filter(*kernels: Sequence[float], repeat_edge: bool = True):
    """Arrow function that applies the kernels in turn to an array column of lines."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(lines: pd.Series) -> pd.Series:
        out = np.stack(lines.to_numpy()).astype(float)
        for kernel in kernels:
            out = filter_lines(out, kernel, repeat_edge)
        return pd.Series(list(out))

    return run


def _lines(pixels: DataFrame, axis: str, *values: str) -> DataFrame:
    """Image lines along ``axis`` as arrays in position order (at most the image side
    long); the image must be a full grid."""
    other = "y" if axis == "x" else "x"
    ordered = F.array_sort(F.collect_list(F.struct(axis, *values)))
    return pixels.groupBy("image_id", other).agg(ordered.alias("_line")).select("image_id", other, *[F.col(f"_line.{v}").alias(v) for v in values])


def _points(lines: DataFrame, axis: str, **values: Column) -> DataFrame:
    """Lines back to pixels; ``values`` are array columns."""
    other = "y" if axis == "x" else "x"
    packed = lines.select("image_id", other, *[v.alias(n) for n, v in values.items()])
    cells = F.arrays_zip(F.sequence(F.lit(0), F.size(next(iter(values))) - 1).alias(axis), *values)
    return packed.select("image_id", other, F.inline(cells)).select("image_id", "y", "x", *values)


def separable_blur(pixels: DataFrame, kernel: Sequence[float], repeat_edge: bool = True) -> DataFrame:
    """Symmetric separable filter: one pass over columns, one over rows. A pass gathers
    lines and filters them in Arrow batches, so no pixel pairs exist and each pixel moves
    once per pass."""
    run = _line_filter(kernel, repeat_edge=repeat_edge)
    for axis in ("y", "x"):
        pixels = _points(_lines(pixels, axis, "v"), axis, v=run(F.col("v")))
    return pixels


def gaussian_blur(pixels: DataFrame, sigma: float) -> DataFrame:
    return separable_blur(pixels, gaussian_kernel(sigma))


def smooth(pixels: DataFrame) -> DataFrame:
    """5 x 5 blur, rounded back to 8 bits; edges mirror without repeating the border."""
    soft = separable_blur(pixels, SMOOTH_KERNEL, repeat_edge=False)
    return soft.withColumn("v", F.floor(F.col("v") + 0.5).cast("int"))


def sharpen(pixels: DataFrame, first: float = 3.0, second: float = 1.0, alpha: float = 30.0) -> DataFrame:
    """``b1 + alpha (b1 - b2)`` with ``b1 = G(first) image`` and ``b2 = G(second) b1``.

    Filters along different axes commute, so both blurs run together: columns give
    ``G1 v`` and ``G2 G1 v``, rows finish both. Two shuffles, and no join of b1 with b2.
    """
    wide, narrow = gaussian_kernel(first), gaussian_kernel(second)
    once, twice = _line_filter(wide), _line_filter(wide, narrow)
    half = _points(_lines(pixels, "y", "v"), "y", b1=once(F.col("v")), b2=twice(F.col("v")))
    full = _points(_lines(half, "x", "b1", "b2"), "x", b1=once(F.col("b1")), b2=twice(F.col("b2")))
    return full.select("image_id", "y", "x", (F.col("b1") + (F.col("b1") - F.col("b2")) * alpha).alias("v"))


def local_maxima(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Pixels strictly greater than all their (up to 8) neighbours.

    Separable: the largest value of the three pixels of each row segment first, then the
    rows above and below, with windows over one image line (at most the image side).
    """
    across = Window.partitionBy("image_id", "y").orderBy("x")
    down = Window.partitionBy("image_id", "x").orderBy("y")

    def beside(move, axis: str, column: str, window: Window, step: int) -> Column:
        # a gap in the pixel table is not a neighbour
        return F.when(move(axis).over(window) == F.col(axis) + step, move(column).over(window))

    sides = pixels.withColumns(
        {"_left": beside(F.lag, "x", value, across, -1), "_right": beside(F.lead, "x", value, across, 1)}
    )
    rows = sides.withColumn("_side", F.greatest("_left", "_right")).withColumn("_row", F.greatest("_side", value))
    stacked = rows.withColumns(
        {"_up": beside(F.lag, "y", "_row", down, -1), "_down": beside(F.lead, "y", "_row", down, 1)}
    )
    around = F.greatest("_side", "_up", "_down")
    return stacked.where(F.col(value) > around).select("image_id", "y", "x", value)


def warp(pixels: DataFrame, homographies: DataFrame, width: int, height: int) -> DataFrame:
    """Warp every image by its homography onto a canvas of the same size, bilinear, zero
    outside. Output pixels look up their four source neighbours by an equi join."""
    back = homographies.select("image_id", inverse(F.col("h")).alias("_h"))
    placed = pixels.select("image_id", "y", "x").join(back, "image_id")
    h = F.col("_h")
    w = h[6] * F.col("x") + h[7] * F.col("y") + h[8]
    placed = placed.withColumns(
        {
            "_u": (h[0] * F.col("x") + h[1] * F.col("y") + h[2]) / w,
            "_v": (h[3] * F.col("x") + h[4] * F.col("y") + h[5]) / w,
        }
    ).withColumns({"_u": F.round("_u", 9), "_v": F.round("_v", 9)})
    fu, fv = F.floor("_u"), F.floor("_v")
    du, dv = F.col("_u") - fu, F.col("_v") - fv
    corners = F.array(
        F.struct(fu.cast("int").alias("_sx"), fv.cast("int").alias("_sy"), ((1 - du) * (1 - dv)).alias("_w")),
        F.struct((fu + 1).cast("int").alias("_sx"), fv.cast("int").alias("_sy"), (du * (1 - dv)).alias("_w")),
        F.struct(fu.cast("int").alias("_sx"), (fv + 1).cast("int").alias("_sy"), ((1 - du) * dv).alias("_w")),
        F.struct((fu + 1).cast("int").alias("_sx"), (fv + 1).cast("int").alias("_sy"), (du * dv).alias("_w")),
    )
    wanted = placed.select("image_id", "y", "x", F.inline(corners)).where(F.col("_w") > 0)
    source = pixels.select("image_id", F.col("y").alias("_sy"), F.col("x").alias("_sx"), "v")
    mixed = wanted.join(source, ["image_id", "_sy", "_sx"]).groupBy("image_id", "y", "x").agg(
        F.sum(F.col("_w") * F.col("v")).alias("v")
    )
    return pixels.select("image_id", "y", "x").join(mixed, ["image_id", "y", "x"], "left").fillna({"v": 0.0})


def inverse(h: Column) -> Column:
    """Adjugate of a 3 x 3 array; the scale cancels in the projection."""
    a, b, c, d, e, f, g, i, k = (h[n] for n in range(9))
    return F.array(
        e * k - f * i, c * i - b * k, b * f - c * e,
        f * g - d * k, a * k - c * g, c * d - a * f,
        d * i - e * g, b * g - a * i, a * e - b * d,
    )
