"""Colour expressions on 8-bit channels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights of ITU-R BT.601.
LUMA = {"r": 0.299, "g": 0.587, "b": 0.114}
# sRGB to XYZ rows for Y and Z and the D65 white point (IEC 61966-2-1),
# and the CIE 1976 break point and linear part.
XYZ_Y = (0.212671, 0.715160, 0.072169)
XYZ_Z = (0.019334, 0.119193, 0.950227)
WHITE_Z = 1.088754
LAB_BREAK = 0.008856
LAB_SLOPE, LAB_OFFSET = 7.787, 16.0 / 116.0
# Flower intensity in Lab b, its sigmoid value and distance to the midpoint.
FLOWER_LEVEL = 155
SIGMOID_VALUE, SIGMOID_DISTANCE = 0.99, 6


def grey(b: Column, g: Column, r: Column) -> Column:
    return F.floor(r * LUMA["r"] + g * LUMA["g"] + b * LUMA["b"] + 0.5).cast("int")


def _linear(channel: Column) -> Column:
    c = channel / F.lit(255.0)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _lab_root(t: Column) -> Column:
    return F.when(t > LAB_BREAK, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * LAB_SLOPE + LAB_OFFSET)


def lab_b(b: Column, g: Column, r: Column) -> Column:
    """8-bit CIE Lab b channel: ``200 (f(Y) - f(Z)) + 128``, rounded and clipped."""
    lb, lg, lr = _linear(b), _linear(g), _linear(r)
    y = lr * XYZ_Y[0] + lg * XYZ_Y[1] + lb * XYZ_Y[2]
    z = (lr * XYZ_Z[0] + lg * XYZ_Z[1] + lb * XYZ_Z[2]) / WHITE_Z
    value = F.floor((_lab_root(y) - _lab_root(z)) * 200.0 + 128.5)
    return F.greatest(F.least(value, F.lit(255)), F.lit(0)).cast("int")


def highlight_unit(v: Column, midpoint: Column, distance: int = SIGMOID_DISTANCE) -> Column:
    """Sigmoid in 0..1 that is 0.99 at ``distance`` above the midpoint."""
    k = math.log(1 / SIGMOID_VALUE - 1) / distance
    return F.lit(1.0) / (F.lit(1.0) + F.exp((v - midpoint) * F.lit(k)))


def highlight(v: Column, shift: Column) -> Column:
    """8-bit flower highlight; the midpoint wraps at 256."""
    midpoint = F.pmod(shift + (FLOWER_LEVEL - SIGMOID_DISTANCE), F.lit(256))
    return F.floor(highlight_unit(v, midpoint) * 255.0).cast("int")


def intensity_ramp(v: Column, threshold: Column) -> Column:
    """Linear ramp in 0..1 around a threshold."""
    upper = threshold + 10
    clipped = F.greatest(F.least(v, upper), F.lit(0))
    return F.greatest(F.least((clipped - (threshold - 8)) / F.nullif(upper, F.lit(0)), F.lit(1.0)), F.lit(0.0))


def signed_byte(index: Column) -> Column:
    """Two's complement value of the low byte."""
    low = F.pmod(index, F.lit(256))
    return F.when(low > 127, low - 256).otherwise(low)
