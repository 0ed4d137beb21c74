"""Normal distribution columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(x) * ERF_P)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def normal_cdf(v: Column, mean: Column, std: Column) -> Column:
    return (erf((v - mean) / (F.nullif(std, F.lit(0.0)) * math.sqrt(2.0))) + 1.0) * 0.5


def normal_pdf(v: Column, mean: Column, std: Column) -> Column:
    z = (v - mean) / F.nullif(std, F.lit(0.0))
    return F.exp(z * z * -0.5) / (std * math.sqrt(2.0 * math.pi))
