"""Prefix computations (running sums, ranks, carried values) without a window that puts a
hot key into one task.

All rows are dealt out by ranges of (key, order columns), and the number of the range is the
slice of a row: a key of ordinary size lies in one or two slices, a hot one in many, and runs of
equal order values are cut by the columns after them. Each quantity is then computed twice: inside
(key, slice), and over the table of one row per (key, slice) that carries it from slice to slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from furrow.session import default_slices, materialize

SLICE = "_slice"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which NULL equals NULL, as it does for windows and groups."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    matches = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, matches, how).drop(*[f"_right_{k}" for k in keys])


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Adds the slice number of every row: slices follow one another in the order of keys and ``order``.

    The table is written out once with its slices. Ranges are drawn from a sample, so they may come out different when
    they are computed again, and a row must not change its slice between two uses.
    """
    n = slices or default_slices(df)
    return materialize(df.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id()))


def inside(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Window over the rows of one key in one slice."""
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def across(keys: Sequence[str]) -> WindowSpec:
    """Window over the slices of one key, for tables of one row per (key, slice): at most
    as many rows per key as there are slices."""
    return Window.partitionBy(*keys).orderBy(SLICE)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], slices: int | None = None
) -> DataFrame:
    """Inclusive running sum of each expression per key, in ``order``, any orderable columns."""
    cut = sliced(df, keys, order, slices)
    upto = inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({n: F.sum(e).over(upto) for n, e in sums.items()})
    before = across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, SLICE)
        .agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
        .select(*keys, SLICE, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums])
    )
    joined = null_safe_join(local, carried, [*keys, SLICE])
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).drop(SLICE, *[f"_c_{n}" for n in sums])


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", slices: int | None = None
) -> DataFrame:
    """1-based row number per key in ``order``."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, slices)


def row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """0-based position in a total order over any orderable columns, strings included.

    A range sort gives each partition a contiguous run; the position inside the partition
    is the low part of the generated id and only partition sizes cross the network. The
    sorted table is written out first, so both uses see the same partitions even when an
    executor is lost between them.
    """
    placed = materialize(
        df.orderBy(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND((1 << 33) - 1)})
        .drop("_id")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    # one row per partition of the sort, so the small side is bounded by the partition count
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )
