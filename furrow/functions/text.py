"""Names, paths, time strings and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The short codes of the three applications and the name fragments they
# are recognised by (the misspelling occurs in real job names).
JOB_CODES = {
    "imageClustering": "IC",
    "flowerCounter": "FC",
    "imageRegistration": "IR",
    "imageRestration": "IR",
}
# Punctuation that a title slug turns into an underscore.
SLUG_SEPARATORS = (": ", " (", " ")
# Group and band in a band file name, IMG_<group>_<band>.<ext>.
BAND_NAME = r"IMG_(.+)_([^_.]+)(?:\.[^._]*)?$"
# Image extensions that are collected, all lower or all upper case.
IMAGE_NAME = r"\.(jpg|tiff|tif|png|JPG|TIFF|TIF|PNG)$"
EVENT_TIME = "yyyy-MMM-dd HH:mm:ss"
METRIC_TIME = "yyyy-MM-dd'T'HH:mm:ss"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def with_extension(path: Column, extension: str) -> Column:
    """File name of ``path`` with its last extension replaced."""
    return F.concat(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), F.lit(extension))


def group_key(path: Column) -> Column:
    return F.regexp_extract(path, BAND_NAME, 1)


def band_number(path: Column) -> Column:
    return F.try_to_number(F.regexp_extract(path, BAND_NAME, 2), F.lit("999999999")).cast("int")


def flat_name(path: Column) -> Column:
    """Directory folded into the file name: ``/a/b/c.png`` -> ``a_bc.png``."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.concat(F.regexp_replace(F.translate(folder, "/", "_"), "^_", ""), base_name(path))


def wall_clock(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), EVENT_TIME)


def metric_seconds(text: Column) -> Column:
    """Epoch seconds of the first 19 characters of an ISO time string."""
    return F.unix_seconds(F.to_timestamp(F.substring(text, 1, 19), METRIC_TIME))


def bytes_to_kb(value: Column) -> Column:
    return value / F.lit(1024.0)


def kb_to_gb(value: Column) -> Column:
    return (value / F.lit(1000000.0)).cast("long")


def whole_seconds(ms: Column) -> Column:
    return F.floor(ms / F.lit(1000)).cast("long")


def job_code(name: Column) -> Column:
    code = F.lit(None).cast("string")
    for fragment, short in JOB_CODES.items():
        code = F.when(name.contains(fragment), short).otherwise(code)
    return code


def slug(title: Column) -> Column:
    out = F.lower(F.replace(title, F.lit(")"), F.lit("")))
    for separator in SLUG_SEPARATORS:
        out = F.replace(out, F.lit(separator), F.lit("_"))
    return out


def image_size(text: Column) -> Column:
    """``"1280x720"`` (width x height) -> ``[720, 1280]``."""
    return F.reverse(F.split(text, "x").cast("array<int>"))


def run_name(prefix: str, folder: Column) -> Column:
    last = F.substring_index(F.rtrim(folder, F.lit("/")), "/", -1)
    return F.concat(F.lit(prefix), F.translate(last, "-.", "__"))


def is_image_name(path: Column) -> Column:
    return path.rlike(IMAGE_NAME)
