"""Session defaults and the one place that decides where intermediate tables live."""

from __future__ import annotations

import atexit
import io
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from tempfile import NamedTemporaryFile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "furrow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_furrow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path(root.name) / file.relative_to(root))
    # the driver's own file server hands this file out; executors fetch it from there
    with NamedTemporaryFile(prefix="furrow-", suffix=".zip", delete=False) as out:
        out.write(packed.getvalue())
    atexit.register(Path(out.name).unlink, missing_ok=True)
    sc.addPyFile(out.name)
    sc._furrow_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which every executor can reach.

    It is the one that the session names in ``spark.checkpoint.dir``. Where none is named, it
    lies in the warehouse, which executors share as well.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_furrow_intermediate"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; it goes when the application ends."""
    path = f"{shared_folder(spark)}/furrow-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Lets Spark remove an execution's shuffle files when it ends, not whenever the driver happens to collect garbage."""
    before = spark.conf.get(RELEASE_CONF, None)
    spark.conf.set(RELEASE_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE_CONF)
        else:
            spark.conf.set(RELEASE_CONF, before)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` once, as Parquet in the shared folder, and reads it from there. Nothing reads its shuffle files again."""
    path = new_folder(df.sparkSession)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` with a table in the shared folder."""
    return stored(df)


# Bytes of a side that may be sent to every executor on purpose, and those of a row of a few numbers or a short name.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 80


def broadcast_if_small(df: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Marks a written-out table for broadcast when rows of about ``row_bytes`` bytes add up to at most
    ``BROADCAST_BYTES``; a larger one stays as it is and joins by shuffle."""
    rows = BROADCAST_BYTES // row_bytes
    small = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as the session shuffles to, for groups that cost time rather than bytes:
    adaptive execution puts small partitions together only where it was not told their number."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def default_slices(df: DataFrame) -> int:
    """How many ordered slices a prefix computation is cut into."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
