"""Best-fit packing by minimum bin slack.

A sequence is filled around the longest piece left: subset-sum dynamic programming over the lengths still
available, on bitsets, finds the fullest combination that fits, and its pieces are removed. Pieces of one length
are alike, so the state is a count for each length, at most ``size`` numbers whatever the corpus holds; and a
combination is taken as often as the counts allow, which uses up at least one length each time. All pieces are
packed together, in at most ``size`` steps; no part of the corpus has left-over sequences of its own.

A piece then is a length and a number among the pieces of that length, and the plan says for each run of numbers in
which sequences and at which offset they lie. Numbers come from counts per task and length, so that a length that
a third of all pieces have is no hot key.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.llm.bytehash import slices
from furrow.llm.token_files import SLICE, vocabulary_path
from furrow.llm.tokens import Encoder
from furrow.session import stored

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, number long"


def fullest(counts: np.ndarray, space: int) -> list[int]:
    """Lengths that fill ``space`` as far as any choice among ``counts`` can, long ones first."""
    mask, reach = (1 << (space + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # reachable sums before the step, length, how many
    for length in np.flatnonzero(counts[: space + 1])[::-1].tolist():
        left, take = min(int(counts[length]), space // length), 1
        while left:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> space & 1:
            break
    total, out = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            out += [length] * take
            total -= length * take
    return out


def plan(counts: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Rows ``length, first number, end of numbers, first sequence, offset``, and the number of sequences.
    ``counts[n]`` is the number of pieces of length n."""
    left, used = counts.astype(np.int64).copy(), np.zeros(size + 1, np.int64)
    rows, sequences = [], 0
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        chosen = [longest, *fullest(left, size - longest)]
        left[longest] += 1
        uses = Counter(chosen)
        times = min(int(left[n]) // k for n, k in uses.items())
        offset = 0
        for n in chosen:
            rows.append((n, used[n], used[n] + times, sequences, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequences += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequences


def encode_pieces(vocabulary: str, end_id: int, size: int):
    """Pieces of at most ``size`` ids, numbered within this task and their length."""

    def run(batches):
        encoder, task = Encoder.of(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, offsets = encoder.encode(part.column("text"))
                ids = np.insert(ids, offsets[1:], encoder.dtype.type(end_id)).astype(encoder.dtype)
                offsets = offsets + np.arange(len(offsets))
                count = -(-np.diff(offsets) // size)
                doc = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                begin = offsets[doc] + piece * size
                stop = np.minimum(begin + size, offsets[doc + 1])
                length = stop - begin
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                number = np.empty(len(length), np.int64)
                number[order] = seen[length[order]] + np.arange(len(order)) - first
                seen += np.bincount(length, minlength=size + 1)
                raw = [ids[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                key = part.column("id").to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, mask=key == C.NO_ID), pa.array(piece.astype(np.int32)), pa.array(piece * size),
                        pa.array(length), pa.array([zlib.crc32(r.astype("<u4")) for r in raw], pa.int64()),
                        pa.array([r.tobytes() for r in raw], pa.binary()),
                        pa.array(np.full(len(doc), task, np.int32)), pa.array(number),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "number"],
                )

    return run


def place_pieces(table: np.ndarray, size: int, columns: list[str]):
    """Looks up sequence and offset by length and number."""
    first = np.searchsorted(table[:, 0], np.arange(size + 2))

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                rows = table[first[n] : first[n + 1]]
                row = rows[np.searchsorted(rows[:, 1], number[mine], side="right") - 1]
                sequence[mine] = row[:, 3] + number[mine] - row[:, 1]
                offset[mine] = row[:, 4]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset``: the pieces of all documents, packed.

    Every row is encoded whole and gets ``end_id``; only documents above ``size`` ids are cut, and only their last
    piece may be shorter than ``size``. Null and empty texts are the end id alone. Repeated rows are packed each;
    a null id stays null. Other columns are not read. ``ids`` holds the ids of a piece as little-endian unsigned
    integers, two bytes each if the vocabulary fits; ``sequences`` joins them.
    """
    texts = docs.select(C.key_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(texts.mapInArrow(C.frugal(encode_pieces(vocabulary, end_id, size), "encoders"), PIECE))
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("pieces"))
    per_task = stored(per_task)
    counts = np.zeros(size + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("pieces").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    table, _ = plan(counts, size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.withColumn("base", F.coalesce(F.sum("pieces").over(before), F.lit(0))).drop("pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    numbered = pieces.join(bases, ["task", "length"]).select(*columns, (F.col("number") + F.col("base")).alias("number"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return numbered.mapInArrow(C.frugal(place_pieces(table, size, columns)), f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the packed sequences, with the pieces' ids joined in order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
    )


def op6_best_fit(spark, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, of pieces with end id 0."""
    return pack(C.table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), 0, ids=False)
