"""Token ids in flat files of unsigned integers, with 64-bit document offsets beside them.

Format of a folder: for each part ``part-00000.ids`` (token ids, little-endian unsigned, 2 bytes where the
vocabulary fits and 4 otherwise), ``part-00000.docs`` (64-bit document ids) and ``part-00000.offsets`` (64-bit
places in the ids file, one more than documents). Parts hold documents in ascending order, and so do the parts
themselves. The manifest gives each part's counts and its base, a prefix sum over the parts before it; a
document's place in the whole is base plus offset. Files are read by memory mapping.
"""

from __future__ import annotations

import os
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.llm.bytehash import slices
from furrow.llm.tokens import Encoder
from furrow.session import new_folder, stored
from furrow.sources.output import Output, qualified

SLICE = 4 << 20
MANIFEST = "part int, path string, docs long, tokens long, bytes_per_id int"


def mapped(uri: str, dtype) -> np.ndarray:
    """The file as an array; memory-mapped where it lies in a mounted folder."""
    if urlparse(uri).scheme in ("", "file"):
        path = urlparse(uri).path
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def write_parts(folder: str, vocabulary: str, end_id: int):
    def run(batches):
        encoder, part = Encoder.of(vocabulary), TaskContext.get().partitionId()
        path = f"{folder}/part-{part:05d}"
        files, tokens, docs = None, 0, 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                if files is None:
                    files = [Output(f"{path}.{kind}") for kind in ("ids", "docs", "offsets")]
                    files[2].file.write(np.zeros(1, "<i8").tobytes())
                ids, offsets = encoder.encode(piece.column("text"))
                n = len(offsets) - 1
                # the end id goes in behind each document
                ids = np.insert(ids, offsets[1:], encoder.dtype.type(end_id))
                offsets = offsets[1:] + np.arange(1, n + 1)
                files[0].file.write(ids.astype(encoder.dtype).tobytes())
                files[1].file.write(piece.column("id").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                files[2].file.write((offsets + tokens).astype("<i8").tobytes())
                tokens, docs = tokens + len(ids), docs + n
        if files is not None:
            for file in files:
                file.commit()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": path, "docs": docs, "tokens": tokens, "bytes_per_id": encoder.dtype.itemsize}],
                schema=pa.schema([
                    ("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes_per_id", pa.int32()),
                ]),
            )

    return run


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes every whole text, appends ``end_id``, writes the files and returns the manifest
    ``part, path, docs, tokens, bytes_per_id, base``.

    Documents are in ascending order of id, a null id first; rows that repeat an id are ordered by a hash of the
    text and all written. Null and empty texts give the end id alone. Other columns are not read. An empty table
    gives an empty manifest.
    """
    spark = docs.sparkSession
    texts = C.keyed(docs, id_col, text_col, 1).select("id", "th", "text")
    ordered = texts.repartitionByRange(C.shuffle_partitions(spark), "id", "th").sortWithinPartitions("id", "th")
    written = stored(ordered.mapInArrow(C.frugal(write_parts(qualified(spark, folder), vocabulary, end_id), "encoders"), MANIFEST))
    # one row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_parts(batches):
    for batch in batches:
        for part in batch.to_pylist():
            ids = mapped(part["path"] + ".ids", f"<u{part['bytes_per_id']}")
            docs, offsets = mapped(part["path"] + ".docs", "<i8"), mapped(part["path"] + ".offsets", "<i8")
            for first in range(0, len(docs), 10_000):
                name = np.array(docs[first : first + 10_000])
                at = np.array(offsets[first : first + len(name) + 1])
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name, mask=name == C.NO_ID),
                        pa.array(at[:-1] + part["base"]),
                        pa.array(np.diff(at)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files of a manifest."""
    spread = manifest.repartition(C.shuffle_partitions(manifest.sparkSession))
    return spread.mapInArrow(read_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file, which driver and executors have installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """Byte-level ids with end id 2, written to files in the shared folder and read back."""
    docs = C.table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, new_folder(spark), vocabulary_path("byte_bpe_50k.json"), 2))
