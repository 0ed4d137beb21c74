"""Exact dedup by content-defined chunk recipes.

Texts are cut where a rolling hash of their last 32 bytes says so, hence equal passages are cut alike
wherever they stand. A chunk is named by a 64-bit hash, and the name is verified: where the corpus holds
several SHA-256 digests under one name, a variant number tells them apart. A text then is its recipe, the
ordered list of its chunk names, and two texts are equal when their recipes are. The bytes of a text are
read once, in the task that reads the file; what moves is about 60 bytes for each kilobyte.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.llm.bytehash import bytes_of, slices
from furrow.session import broadcast_if_small, stored

# Sizes of chunks in bytes: no cut before LEAST, a cut for one in AVERAGE positions, at MOST in any case.
LEAST, AVERAGE, MOST = 256, 1024, 8192
WINDOW = 32


@lru_cache(maxsize=None)
def gear() -> np.ndarray:
    return np.random.default_rng(31).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, as places in ``data``."""
    h = gear()[data]
    step = 1
    while step < WINDOW:
        # the sum over twice as many bytes; the older half counts shifted
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h, step = wider, step * 2
    marks = np.flatnonzero((h >> np.uint32(32 - AVERAGE.bit_length() + 1)) == 0) + 1
    bounds = np.searchsorted(marks, offsets, side="right")
    cuts = []
    for d in range(len(offsets) - 1):
        begin, stop, out = int(offsets[d]), int(offsets[d + 1]), []
        # a mark counts only if its window lies in the text; LEAST sees to that
        for mark in marks[bounds[d] : bounds[d + 1]].tolist():
            while mark - begin > MOST:
                begin += MOST
                out.append(begin)
            if mark - begin >= LEAST:
                begin = mark
                out.append(begin)
        while stop - begin > MOST:
            begin += MOST
            out.append(begin)
        if stop > begin:
            out.append(stop)
        cuts.append(out)
    return cuts


CHUNK = pa.list_(pa.struct([("place", pa.int32()), ("name", pa.int64()), ("digest", pa.binary())]))


def recipes(batches):
    """SHA-256 of each text, and name and digest of its chunks."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = bytes_of(part.column("text"))
            raw = memoryview(np.ascontiguousarray(data))
            whole, chunks = [], []
            for d, ends in enumerate(cut_points(data, offsets)):
                begin, found = int(offsets[d]), []
                whole.append(hashlib.sha256(raw[begin : int(offsets[d + 1])]).hexdigest())
                for place, end in enumerate(ends):
                    piece = raw[begin:end]
                    name = xxhash.xxh64(piece).intdigest()
                    found.append({"place": place, "name": name - (name >> 63 << 64), "digest": hashlib.sha256(piece).digest()})
                    begin = end
                chunks.append(found)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("th"), pa.array(whole, pa.string()), pa.array(chunks, CHUNK)],
                names=["id", "th", "text_sha256", "chunks"],
            )


def with_variants(chunks: DataFrame) -> DataFrame:
    """Adds ``variant`` to chunks ``name, digest``: a number that tells digests of one name apart, NULL where a name has
    one digest. That is all of them, unless 64 bits collide; so chunks stay where they are, and only one partial row for
    each name and task moves."""
    clashing = stored(chunks.groupBy("name").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("name"))
    variants = stored(
        chunks.join(broadcast_if_small(clashing), "name", "left_semi")
        .select("name", "digest").distinct()
        .withColumn("variant", F.row_number().over(Window.partitionBy("name").orderBy("digest")))
    )
    return chunks.join(broadcast_if_small(variants), ["name", "digest"], "left")


RECIPES = "id long, th int, text_sha256 string, chunks array<struct<place:int,name:long,digest:binary>>"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row of ``docs``.

    Texts are equal when identical; null counts as empty, and all empty texts are equal. Of equal texts the row
    with the largest id stays; a null id is the smallest. Rows that repeat an id and its text are all marked alike
    and count in ``group_size``. Other columns are not read.
    """
    texts = C.keyed(docs, id_col, text_col, 1).select("id", "th", "text")
    return grouped(stored(texts.mapInArrow(C.frugal(recipes), RECIPES)))


def grouped(read: DataFrame) -> DataFrame:
    """The result of ``exact_dedup`` from the recipes of all rows."""
    # one row per document key; repeated rows are counted
    rows = read.groupBy("id", "th", "text_sha256").agg(F.count("*").alias("times"))
    chunks = read.select("id", "th", "text_sha256", F.explode("chunks").alias("c")).select("id", "th", "text_sha256", "c.*")
    named = with_variants(chunks)
    entry = F.struct("place", "name", F.coalesce("variant", F.lit(0)).alias("variant"))
    listed = named.groupBy("id", "th", "text_sha256").agg(F.sort_array(F.collect_set(entry)).alias("recipe"))
    recipe = F.coalesce("recipe", F.array().cast("array<struct<place:int,name:long,variant:int>>"))
    whole = rows.join(listed, ["id", "th", "text_sha256"], "left").withColumn("recipe", recipe)
    whole = stored(whole.withColumn("recipe_hash", F.xxhash64("recipe")))
    groups = whole.groupBy("recipe_hash", "recipe").agg(F.max("id").alias("keep"), F.sum("times").alias("group_size"))
    own = lambda c: F.when(c != C.NO_ID, c)
    return (
        whole.join(groups, ["recipe_hash", "recipe"])
        .select(
            own(F.col("id")).alias("doc_id"),
            own(F.col("keep")).alias("keep_id"),
            "group_size",
            (F.col("id") == F.col("keep")).alias("kept"),
            "text_sha256",
            F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_time"),
        )
        .drop("_time")
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(C.table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body)
"""
