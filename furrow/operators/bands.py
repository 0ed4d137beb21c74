"""Band sets of a group: grouping, alignment, index products, homographies and canvas.

Band table: ``group_key, band, name, y, x, v``. Homography table: ``group_key, band,
h ARRAY<DOUBLE>`` (9 values, row-major).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.geometry import decompose, project, squared_residual
from furrow.operators.ordered import row_index

# Bands of one camera group, and which are red, green, blue and near infrared.
BANDS = (1, 2, 3, 4, 5)
RED, GREEN, BLUE, NIR = 3, 2, 1, 4
NDVI_RANGE = (0.3, 0.6)


def group_members(files: DataFrame) -> DataFrame:
    """Every member of each group as a row, with its position by name and the size of its group.

    ``files`` holds ``group_key, name, band, v``. Positions come from one sort of all files by group and name,
    which cuts a hot group like any other run of rows; a group is never one row or one task.
    """
    placed = row_index(files, "group_key", "name", "band", "v", name="_at")
    groups = placed.groupBy("group_key").agg(F.min("_at").alias("_first"), F.count("*").alias("n_members"))
    joined = placed.join(groups, "group_key")
    return joined.select("group_key", (F.col("_at") - F.col("_first")).alias("pos"), "name", "band", "v", "n_members")


def first_of_group(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First member by name of every group."""
    return files.groupBy("group_key").agg(F.min("name").alias("name"), *[F.min_by(c, "name").alias(c) for c in columns])


def align_bands(bands: DataFrame, numbers: Sequence[int] = BANDS) -> DataFrame:
    """One row per (group, y, x) with a column per band and ``set_aside``, the number of values that have no column:
    those of other bands, and all but one of a band that comes several times (the smallest stays). A fixed band list
    needs no scan for pivot values."""
    columns = [F.when(F.col("band") == n, F.col("v")) for n in numbers]
    present = sum((F.max((F.col("band") == n).cast("long")) for n in numbers), F.lit(0))
    return bands.groupBy("group_key", "y", "x").agg(
        *[F.min(c).alias(f"b{n}") for c, n in zip(columns, numbers, strict=True)], (F.count("*") - present).alias("set_aside")
    )


def ndvi(red: Column, nir: Column) -> Column:
    return (nir - red) / F.nullif(nir + red, F.lit(0.0))


def with_ndvi(aligned: DataFrame) -> DataFrame:
    return aligned.withColumn("ndvi", ndvi(F.col(f"b{RED}"), F.col(f"b{NIR}")))


def ndvi_mask(value: Column) -> Column:
    """1 inside the vegetation range, else 0; missing stays missing."""
    return F.when(value.isNull(), F.lit(None)).otherwise((value >= NDVI_RANGE[0]) & (value <= NDVI_RANGE[1])).cast("int")


def with_rgb(aligned: DataFrame) -> DataFrame:
    return aligned.withColumn("rgb", F.array(f"b{RED}", f"b{GREEN}", f"b{BLUE}"))


def back_projection(matches: DataFrame, homographies: DataFrame) -> DataFrame:
    """Sum of squared residuals over the inliers and their number, per homography."""
    h = F.col("h")
    residual = squared_residual(h, F.col("xs"), F.col("ys"), F.col("xd"), F.col("yd"))
    return (
        matches.join(homographies, ["group_key", "band"])
        .groupBy("group_key", "band")
        .agg(
            F.coalesce(F.sum(F.when(F.col("inlier") == 1, residual)), F.lit(0.0)).alias("bp_error"),
            F.count_if(F.col("inlier") == 1).alias("inliers"),
        )
    )


def crop_box(homographies: DataFrame, width: int, height: int) -> DataFrame:
    """Common crop of a group; ``sin`` of the largest rotation times the width widens
    both axes."""
    parts = decompose(F.col("h"))
    widest = homographies.groupBy("group_key").agg(
        F.max(F.abs(parts["shift_x"])).alias("mx"),
        F.max(F.abs(parts["shift_y"])).alias("my"),
        F.max(F.abs(parts["theta"])).alias("mt"),
    )
    rot = F.ceil(F.round(F.sin("mt") * width, 9))
    bx, by = F.ceil(F.round("mx", 9)) + rot, F.ceil(F.round("my", 9)) + rot
    return widest.select(
        "group_key", bx.alias("x0"), (width - bx).alias("x1"), by.alias("y0"), (height - by).alias("y1")
    )


def canvas(homographies: DataFrame, width: int, height: int) -> DataFrame:
    """Size and offset of the canvas that holds the fixed image and the moved one."""
    moved = [project(F.col("h"), F.lit(float(x)), F.lit(float(y))) for x in (0, width) for y in (0, height)]
    xs, ys = [m[0] for m in moved], [m[1] for m in moved]
    low_x = F.round(F.least(F.lit(0.0), *xs) - 0.5, 6).cast("int")
    high_x = F.round(F.greatest(F.lit(float(width)), *xs) + 0.5, 6).cast("int")
    low_y = F.round(F.least(F.lit(0.0), *ys) - 0.5, 6).cast("int")
    high_y = F.round(F.greatest(F.lit(float(height)), *ys) + 0.5, 6).cast("int")
    return homographies.select(
        "group_key", "band",
        (high_x - low_x).alias("width"), (high_y - low_y).alias("height"),
        (-low_x).alias("offset_x"), (-low_y).alias("offset_y"),
    )


def ordered_corners(points: DataFrame, key: str) -> DataFrame:
    """Top-left, top-right, bottom-right, bottom-left by coordinate sum and difference.
    The first point by ``pos`` (any orderable column) wins ties; the aggregate keeps one
    partial row per key."""
    total, diff, at = F.col("x") + F.col("y"), F.col("y") - F.col("x"), F.struct("x", "y")
    ranks = {"tl": total, "tr": diff, "br": -total, "bl": -diff}
    return points.groupBy(key).agg(*[F.min_by(at, F.struct(rank, "pos")).alias(name) for name, rank in ranks.items()])


def rectified_size(corners: DataFrame) -> DataFrame:
    """Width and height of the upright image of four ordered corners."""

    def side(a: str, b: str, axis: str) -> Column:
        return F.abs((F.col(f"{a}.{axis}") - F.col(f"{b}.{axis}")).cast("int"))

    return corners.withColumns(
        {
            "width": F.greatest(side("br", "bl", "x"), side("tr", "tl", "x")),
            "height": F.greatest(side("br", "tr", "y"), side("bl", "tl", "y")),
        }
    )


def registered_catalog(boxes: DataFrame, errors: DataFrame, folder: str, commit_hash: str, file_type: str = ".png") -> DataFrame:
    """One row per registered image; a band without error counts as the target (0)."""
    path = F.concat(F.lit(f"{folder}/IMG_"), "group_key", F.lit("_"), F.col("band").cast("string"), F.lit(file_type))
    return errors.join(boxes, "group_key").select(
        "group_key", "band", "x0", "x1", "y0", "y1",
        F.lit(file_type).alias("file_type"),
        F.coalesce("bp_error", F.lit(0.0)).alias("squared_sum_error"),
        F.lit(commit_hash).alias("commit_hash"),
        path.alias("file_path"),
    )
