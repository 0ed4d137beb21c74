"""What several operators share: document keys, hash buckets and packed records.

Records that are far smaller than a Spark row (a hash and a position) travel packed: a task sorts
what a slice of documents gives by bucket and sends one binary row per bucket and slice. Spark still
partitions, shuffles and retries them; only the cost per record goes.
"""

from __future__ import annotations

import ctypes
import gc
import re
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stands for a null id, which sorts before every other.
NO_ID = -(2**63)


# Rows of an Arrow batch and its bytes, which long texts reach first; a task holds a batch on both sides.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session send batches of ``BATCH_ROWS`` and ``BATCH_BYTES`` to Python, unless it was told to send fewer."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < bytes_in(spark.conf.get(name, str(most + 1))) <= most:
            spark.conf.set(name, str(most))


def bytes_in(setting: str) -> int:
    """A number with or without a unit, such as ``64MB``; -1 is none."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets. Two for each shuffle partition: packed rows number at most a task's slices or a
    bucket's records times this."""
    return 2 * shuffle_partitions(spark)


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def dest_of(key: Column, n: int) -> Column:
    """Bucket of a document; ``dest`` below is the same in numpy."""
    return F.pmod(key.bitwiseXOR(F.shiftrightunsigned(key, 17)), F.lit(n)).cast("int")


def dest(ids: np.ndarray, n: int) -> np.ndarray:
    return np.mod(ids ^ (ids.view(np.uint64) >> np.uint64(17)).view(np.int64), n).astype(np.int32)


def keyed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``dest, id, th, text``: documents under a key of their id and a hash of their text.

    Rows with one id and one text share the key; rows with one id and different texts do not.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(key_of(id_col).alias("id"), F.hash(text).alias("th"), text.alias("text"))
    return found.select(dest_of(F.col("id"), n).alias("dest"), "id", "th", "text")


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


# What operators keep in a worker between its tasks, by name.
KEPT: dict[str, dict] = {}


def frugal(run, keeps: str | None = None):
    """A function over batches that releases memory when it ends. When it starts it drops what other operators have
    kept in this worker; only its own, named ``keeps``, stays."""

    @wraps(run)
    def wrapped(batches):
        for name, kept in KEPT.items():
            if name != keeps:
                kept.clear()
        release()
        yield from run(batches)
        release()

    return wrapped


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array, first all low bytes, then all next ones: high bytes that are 0 compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def pack(order: np.ndarray, bucket: np.ndarray, columns: list[np.ndarray]):
    """One ``(bucket, payload)`` for each bucket. ``order`` sorts the records by bucket."""
    if not len(order):
        return
    sorted_bucket = bucket[order]
    cuts = np.flatnonzero(starts(sorted_bucket))
    columns = [c[order] for c in columns]
    for first, last in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(sorted_bucket[first]), b"".join(planes(c[first:last]) for c in columns)


def unpack(payloads, dtypes: list) -> list[np.ndarray]:
    """The columns of packed records, those of all payloads after one another.

    A type ``('u1', n)`` is a fixed number of bytes for each record.
    """
    dtypes = [np.dtype(t) for t in dtypes]
    width = sum(t.itemsize for t in dtypes)
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for payload in payloads:
        n, at = len(payload) // width, 0
        raw = np.frombuffer(payload, np.uint8)
        for out, t in zip(parts, dtypes, strict=True):
            block = np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T)
            out.append(block if t.subdtype else block.view(t).reshape(n))
            at += n * t.itemsize
    return [
        np.concatenate(p) if p else np.zeros((0, t.itemsize), np.uint8) if t.subdtype else np.zeros(0, t)
        for p, t in zip(parts, dtypes, strict=True)
    ]


def rows(kind: int, packed, key: str = "bucket") -> pa.RecordBatch:
    packed = list(packed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b for b, _ in packed], pa.int32()),
            pa.array([kind] * len(packed), pa.int32()),
            pa.array([p for _, p in packed], pa.binary()),
        ],
        names=[key, "kind", "payload"],
    )


def payloads(group: pa.Table, kind: int) -> list[bytes]:
    column = group.column("payload")
    return [column[i].as_py() for i, k in enumerate(group.column("kind").to_pylist()) if k == kind]


def starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def merged(start: np.ndarray, stop: np.ndarray, doc: np.ndarray):
    """Maximal runs of intervals that touch or overlap, document by document: ``doc, start, stop``."""
    if not len(start):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    # running maximum within a document: documents are numbered upwards, so an offset keeps them apart
    step = int(stop.max()) + 1
    number = np.cumsum(starts(doc)) - 1
    reach = np.maximum.accumulate(stop + number * step) - number * step
    new = starts(doc)
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    return doc[first], start[first], reach[last]
