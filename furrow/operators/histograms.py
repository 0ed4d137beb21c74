"""Per-image histograms and what follows from them: shifts, thresholds, flower pixels.

Long form is ``image_id, bin, n`` (non-zero bins only); dense form is an array of 256
counts. Both hold at most 256 entries per image, whatever the image size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from furrow.functions.colour import FLOWER_LEVEL, signed_byte

BINS = 256
# Share of the fullest grey bin from which an image counts as damaged,
# and the b-channel range of the older percentage job.
CORRUPT_SHARE = 0.2
PERCENT_RANGE = (155, 255)


def histogram(pixels: DataFrame, value: str = "v", image: str = "image_id") -> DataFrame:
    """Counts per (image, bin). The partial aggregation leaves at most 256 rows per
    image and task before the shuffle, so a huge image is not a hot key."""
    return pixels.groupBy(F.col(image).alias("image_id"), F.col(value).cast("int").alias("bin")).agg(
        F.count("*").alias("n")
    )


def zero_filled(hist: DataFrame) -> DataFrame:
    """Long form with all 256 bins of every image."""
    return dense(hist).select("image_id", F.posexplode("hist").alias("bin", "n"))


def dense(hist: DataFrame, name: str = "hist") -> DataFrame:
    """One array of 256 counts per image: each count is followed by the zeros up to the
    next bin present."""
    bins = F.array_sort(F.collect_list(F.struct("bin", "n")))
    zero = F.lit(0).cast("long")

    def run(b: Column, i: Column) -> Column:
        following = F.coalesce(F.get("_b", i + 1)["bin"], F.lit(BINS))
        return F.concat(F.array(b["n"]), F.array_repeat(zero, following - b["bin"] - 1))

    head = F.array_repeat(zero, F.get("_b", F.lit(0))["bin"])
    return (
        hist.groupBy("image_id")
        .agg(bins.alias("_b"))
        .select("image_id", F.concat(head, F.flatten(F.transform("_b", run))).alias(name))
    )


def sum_vector(vectors: DataFrame, column: str) -> DataFrame:
    """Element-wise sum: one row per position."""
    return (
        vectors.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("double")).alias("total"))
    )


def mean_vector(vectors: DataFrame, column: str) -> DataFrame:
    """Element-wise mean: one row per position."""
    return (
        vectors.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )


def first_histogram(hists: DataFrame, column: str = "hist", order: str = "image_id") -> tuple:
    """Key and histogram (256 numbers) of the first image, on the driver."""
    return tuple(hists.agg(F.min(order), F.min_by(column, order)).first())


def total_histogram(hists: DataFrame, column: str = "hist") -> list[float]:
    """Sum of all histograms (256 numbers), on the driver. The best lag against it equals
    the best lag against the mean."""
    total = [0.0] * BINS
    for row in sum_vector(hists, column).collect():  # one row per bin
        total[row["pos"]] = row["total"]
    return total


def _lags(stack: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Index of the largest full cross-correlation of each row, smallest index on ties:
    one matrix product with the shifted copies of the reference."""
    size = len(reference)
    padded = np.zeros(3 * size - 2)
    padded[size - 1 : 2 * size - 1] = reference
    shifts = np.lib.stride_tricks.sliding_window_view(padded, size)[::-1]
    return (stack @ shifts.T).argmax(axis=1).astype(np.int32)


@F.pandas_udf(IntegerType())
def best_lag(a: pd.Series, v: pd.Series) -> pd.Series:
    """Best lag of ``a`` against ``v``, both on the row; one product per distinct ``v``."""
    out = np.zeros(len(a), dtype=np.int32)
    stack = np.stack(a.to_numpy()).astype(np.float64)
    references = np.stack(v.to_numpy()).astype(np.float64)
    distinct, inverse = np.unique(references, axis=0, return_inverse=True)
    for i, reference in enumerate(distinct):
        rows = np.flatnonzero(inverse.ravel() == i)
        out[rows] = _lags(stack[rows], reference)
    return pd.Series(out)


def best_lag_to(hist: Column, reference: Sequence[float]) -> Column:
    """Best lag against one reference that travels with the function, not with the rows."""

    @F.pandas_udf(IntegerType())
    def lag(a: pd.Series) -> pd.Series:
        return pd.Series(_lags(np.stack(a.to_numpy()).astype(np.float64), np.asarray(reference, np.float64)))

    return lag(hist)


@dataclass(frozen=True)
class Reference:
    """What every image is compared with: key and histogram of the first image, and the
    best lag of that histogram against the total. Small enough to travel with the plan."""

    first: object
    hist: tuple[float, ...]
    ref_lag: int

    @staticmethod
    def of(hists: DataFrame, column: str = "hist", order: str = "image_id") -> Reference:
        first, hist = first_histogram(hists, column, order)
        if first is None:
            return Reference(None, (0.0,) * BINS, 0)
        ref_lag = int(_lags(np.array([hist], float), np.array(total_histogram(hists, column)))[0])
        return Reference(first, tuple(map(float, hist)), ref_lag)

    def shift(self, hists: DataFrame, column: str = "hist", order: str = "image_id") -> DataFrame:
        """Adds ``lag`` (best lag against the first image; 0 for the first image itself),
        ``ref_lag`` and their wrapped sum ``shift``. Row by row, nothing shuffles."""
        lag = F.when(F.col(order) == F.lit(self.first), F.lit(0)).otherwise(best_lag_to(F.col(column), self.hist))
        shifted = hists.withColumns({"lag": lag, "ref_lag": F.lit(self.ref_lag)})
        return shifted.withColumn("shift", F.pmod(F.col("lag") + F.col("ref_lag"), F.lit(BINS)))


def shifts(hists: DataFrame, column: str = "hist", order: str = "image_id") -> DataFrame:
    """``lag``, ``ref_lag`` and ``shift`` of every image against the table's own reference."""
    return Reference.of(hists, column, order).shift(hists, column, order)


def shifts_to_mean(hists: DataFrame, column: str = "hist") -> DataFrame:
    """Older rule: best lag against the mean histogram, as a signed byte."""
    return hists.withColumn("shift", signed_byte(best_lag_to(F.col(column), total_histogram(hists, column))))


def threshold(shift: Column) -> Column:
    return F.pmod(shift + FLOWER_LEVEL, F.lit(BINS))


def _slice_sum(hist: Column, start: Column, length: Column) -> Column:
    return F.aggregate(F.slice(hist, start + 1, length), F.lit(0).cast("long"), lambda s, x: s + x)


def corrupt_score(hist: Column) -> Column:
    """Share of the fullest bin."""
    return F.array_max(hist) / F.nullif(_slice_sum(hist, F.lit(0), F.size(hist)), F.lit(0))


def is_corrupt(hist: Column) -> Column:
    return F.coalesce(corrupt_score(hist) >= CORRUPT_SHARE, F.lit(True))


def flower_pixels(hist: Column, shift: Column) -> Column:
    """Pixels in the bins from the shifted threshold up."""
    start = threshold(shift)
    return _slice_sum(hist, start, F.lit(BINS) - start)


def flower_share(hist: Column, shift: Column, plot_pixels: Column) -> Column:
    """Share of plot pixels inside the shifted range (bounds clipped to the histogram)."""
    low = F.least(shift + PERCENT_RANGE[0], F.lit(BINS))
    high = F.least(shift + PERCENT_RANGE[1] + 1, F.lit(BINS))
    return _slice_sum(hist, low, high - low) / F.nullif(plot_pixels, F.lit(0))


def otsu_threshold(hist: DataFrame) -> DataFrame:
    """Otsu level per image from the long histogram: the bin with the largest
    between-class variance, smallest bin on ties. Running sums live in an array of at
    most 256 bins per image."""
    packed = hist.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"),
        F.sum("n").alias("total"),
        F.sum(F.col("bin") * F.col("n")).alias("mass"),
    )
    # below: (count, mass) of the bins up to and including each bin
    step = F.aggregate(
        "bins",
        F.struct(
            F.lit(0).cast("long").alias("w"),
            F.lit(0).cast("long").alias("m"),
            F.lit(-1.0).alias("best"),
            F.lit(0).alias("level"),
        ),
        lambda s, b: _otsu_step(s, b),
    )
    return packed.select("image_id", step["level"].alias("level"))


def _otsu_step(s: Column, b: Column) -> Column:
    total, mass = F.col("total"), F.col("mass")
    w, m = s["w"] + b["n"], s["m"] + b["bin"] * b["n"]
    rest = F.nullif(total - w, F.lit(0))
    # w1 w2 (mean1 - mean2)^2 = (m T - w M)^2 / (w (T - w)) up to the factor T^2
    gap = (m * total - w * mass).cast("double")
    spread = F.round(F.coalesce(gap * gap / (w * rest).cast("double"), F.lit(-1.0)), 6)
    better = spread > s["best"]
    return F.struct(
        w.alias("w"),
        m.alias("m"),
        F.when(better, spread).otherwise(s["best"]).alias("best"),
        F.when(better, b["bin"]).otherwise(s["level"]).alias("level"),
    )
