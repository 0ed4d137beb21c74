"""Plane geometry on columns: regions, homographies, point sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Corner = tuple[int, int]
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def _turn(p: Corner, q: Corner, x: Column, y: Column) -> Column:
    """Cross product of the edge p->q with the step from q to the pixel."""
    ex, ey = q[0] - p[0], q[1] - p[1]
    return (y - q[1]) * ex - (x - q[0]) * ey


def inside_region(x: Column, y: Column, corners: Sequence[Corner], width: int, height: int) -> Column:
    """Strictly inside the quadrangle (top-left, top-right, bottom-left, bottom-right)."""
    tl, tr, bl, br = corners
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = (
        (x >= max(min(xs), 0)) & (x < min(max(xs), width))
        & (y >= max(min(ys), 0)) & (y < min(max(ys), height))
    )
    left, right = _turn(bl, tl, x, y), _turn(br, tr, x, y)
    top, bottom = _turn(tl, tr, x, y), _turn(bl, br, x, y)
    return box & (left > 0) & (right < 0) & (top > 0) & (bottom < 0)


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Point under a row-major 3 x 3 homography; NULL at infinity."""
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def squared_residual(h: Column, xs: Column, ys: Column, xd: Column, yd: Column) -> Column:
    px, py = project(h, xs, ys)
    return (xd - px) * (xd - px) + (yd - py) * (yd - py)


def decompose(h: Column) -> dict[str, Column]:
    """Translation, rotation, scale and shear of the affine part."""
    a, b, c, d, e, f = (h[i] for i in range(6))
    length = F.sqrt(a * a + b * b)
    det = a * e - b * d
    return {
        "shift_x": c,
        "shift_y": f,
        "theta": F.atan2(b, a),
        "scale_x": length,
        "scale_y": det / F.nullif(length, F.lit(0.0)),
        "shear": (a * d + b * e) / F.nullif(det, F.lit(0.0)),
    }
