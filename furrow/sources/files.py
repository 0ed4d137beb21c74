"""Image files and bundles as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.text import band_number, base_name, flat_name, group_key, is_image_name, with_extension
from furrow.operators.images import decode_grey
from furrow.sources.output import Output, qualified

# Names of images, as a pattern that the listing applies.
IMAGE_GLOB = "*.{jpg,tiff,tif,png,JPG,TIFF,TIF,PNG}"


def scan(spark: SparkSession, path: str | Sequence[str], partitions: int | None = None, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content`` of every file. A pattern or extension
    is applied to the listing, so other files are not opened. Empty files have no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.repartition(partitions) if partitions else files


def decoded(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """``path, height, width, data`` (BGR bytes) of the readable 3-channel images; the
    JVM image source decodes. Files that are no image are dropped, and so are those that end too early."""
    reader = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True)
    image = reader.load(path).select("image.*")
    return image.where("nChannels = 3").select(F.col("origin").alias("path"), "height", "width", "data")


def band_files(files: DataFrame) -> DataFrame:
    """``group_key, band, name, content`` of the files whose name matches the group
    pattern; images stay compressed."""
    key = group_key(F.col("path"))
    return files.where(key != "").select(
        key.alias("group_key"), band_number(F.col("path")).alias("band"), base_name(F.col("path")).alias("name"), "content"
    )


def bands_of(files: DataFrame) -> DataFrame:
    """Decoded bands: ``group_key, band, name, height, width, v`` with v in 0..1."""
    named = files.where(group_key(F.col("path")) != "")
    planes = decode_grey(named, "path", "STRING")
    return planes.select(
        group_key(F.col("path")).alias("group_key"), band_number(F.col("path")).alias("band"),
        base_name(F.col("path")).alias("name"), "height", "width", "v",
    )


def bands(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return bands_of(scan(spark, path))


def catalog_of(files: DataFrame, root: str = "") -> DataFrame:
    """Collection catalog: known image extensions, not empty, folder folded into the name."""
    path = F.regexp_replace("path", "^[a-z]+:/*", "/") if root else F.col("path")
    inside = F.substring(path, F.lit(len(plain_path(root)) + 1), F.length("path"))
    kept = files.where(is_image_name(F.col("path")) & (F.col("length") > 0))
    return kept.select("path", flat_name(inside).alias("name"), "length")


def collect_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Walks a tree; only the listing is read, never the contents, and other files than images are not listed."""
    files = scan(spark, root, recursive=True, glob=IMAGE_GLOB).select("path", "length")
    return catalog_of(files, root)


def subfolders(spark: SparkSession, root: str, prefix: str = "", exclude: Sequence[str] = ()) -> list[str]:
    """The folders of ``root`` whose names start with ``prefix``, but for the excluded ones, in order of name. One listing
    of one folder; files and what lies deeper are not looked at."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = {f.getPath().getName(): f.getPath().toString() for f in found if f.isDirectory()}
    return [names[n] for n in sorted(names) if n.startswith(prefix) and n not in exclude]


def read_datasets(spark: SparkSession, root: str, prefix: str = "", exclude: Sequence[str] = (), glob: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content`` of the files in the camera-day folders of ``root``, and the folder as
    ``dataset``: one read over all folders. Excluded folders are neither listed nor read."""
    folders = subfolders(spark, root, prefix, exclude)
    if not folders:
        return spark.createDataFrame([], "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY, dataset STRING")
    return datasets(scan(spark, folders, recursive=True, glob=glob), root=root)


def datasets(files: DataFrame, prefix: str = "", exclude: Sequence[str] = (), root: str | None = None) -> DataFrame:
    """Adds the camera-day folder as ``dataset``: the first one below ``root``, or else the one that the file lies in."""
    if root is None:
        folder = F.element_at(F.split("path", "/"), -2)
    else:
        path = F.regexp_replace("path", "^[a-z]+:/*", "/")
        below = F.substring(path, F.lit(len(plain_path(root)) + 2), F.length("path"))
        folder = F.substring_index(below, "/", 1)
    out = files.withColumn("dataset", folder).where(F.col("dataset").startswith(prefix))
    return out.where(~F.col("dataset").isin(*exclude)) if exclude else out


def plain_path(path: str) -> str:
    """A path without scheme and end slash."""
    return re.sub("^[a-z]+:/*", "/", path).rstrip("/")


def pack(files: DataFrame, target: str) -> None:
    """Many small files into few large ones: ``(name, content)`` Parquet."""
    files.select(F.col("path").alias("name"), "content").write.mode("overwrite").parquet(target)


def unpack_of(packed: DataFrame) -> DataFrame:
    """One PNG name per bundle entry; entries without a name or content are skipped."""
    kept = packed.where(F.col("name").isNotNull() & F.col("content").isNotNull())
    return kept.withColumn("png_name", with_extension(F.col("name"), ".png"))


def unpack(spark: SparkSession, source: str) -> DataFrame:
    return unpack_of(spark.read.schema("name STRING, content BINARY").parquet(source))


def write_files(rows: DataFrame, folder: str, flat: bool = False, tree: bool = False) -> DataFrame:
    """One file per ``(path, content)`` row in a folder of the session's file system; returns
    ``path, bytes`` when run. Files take the base name of the path, or with ``flat`` its
    folders too, for inputs that repeat a name in several folders; with ``tree`` the folders stay folders. A file is
    renamed to its name once it is whole, so a repeated or speculative task leaves no half one."""
    target = qualified(rows.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                file = Output(f"{target}/{name}")
                file.file.write(content)
                file.commit()
            yield pd.DataFrame({"path": pdf["path"], "bytes": pdf["content"].map(len)})

    local = F.regexp_replace("path", "^[a-z]+:/*", "/")
    name = F.ltrim(local, F.lit("/")) if tree else flat_name(local) if flat else base_name(F.col("path"))
    return rows.select("path", name.alias("name"), "content").mapInPandas(run, "path STRING, bytes BIGINT")
