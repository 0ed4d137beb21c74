"""Suffix-array dedup: removes bytes that a string of ``depth`` bytes covers which also starts earlier.

The suffixes are ordered by a depth-limited, most-significant-digit radix sort: only through ``depth``
bytes, and only as long as a suffix still has an equal. What is equal after ``depth`` bytes is a
repeated window.

* **First digit.** A suffix is dealt out by a gram of 32 bytes inside its first ``depth`` bytes: the one
  with the smallest hash. Equal windows have the same gram at the same place, so no equal pair is parted.
  The suffixes that share a gram occurrence are neighbours and travel as one block: 24 bytes of hashes and
  place instead of a row per suffix. Blocks that are equal as a whole (128 bits of two hashes) are settled
  here, first in the task that read them, then over all; only one of each goes on, and only if its gram
  stands in another block too.
* **Second digit.** A block is cut in two at the gram: windows that reach far to the left of it, and the
  others. Each half is dealt out by the gram and the 34 or 35 bytes beside it, which all its windows hold.
  A common short line, however many documents have it, falls apart here.
* **The whole window.** Where more than ``MANY`` different blocks share a gram, as around a passage that very many
  documents hold, each window of them is a record of its own, dealt out by 128 bits of hash over all its bytes. Equal
  windows of a slice of documents are settled there, so a window comes to one record for each slice.
* **Later digits.** In a bucket suffixes are ordered in passes of 8 bytes; those that stand alone after a
  pass are done. After ``depth`` bytes equal groups are repeated windows, compared byte by byte.

Texts are read twice and shuffled once; copies of a text cost one block hash for each 30 bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.llm.bytehash import RunHash, bytes_of, slices

GRAM = 32
# Different blocks of one gram above which windows are dealt out one by one, and the mark of such a block beside the
# place of its gram.
MANY, MARK = 64, 128
PACKED = "bucket int, kind int, payload binary"
DEALT = "dest int, kind int, payload binary"
CUT = ("blocks", "windows", "spans")

# kinds of packed records
BLOCK, SPAN, REQUEST = 0, 1, 2
BLOCK_TYPES = ["<u8", "<u8", "<i8", "<i4", "<i4", "u1", "u1"]  # gram, block, id, th, start, windows, place of the gram
SPAN_TYPES = ["<i8", "<i4", "<i4", "<i4"]  # id, th, start, stop
WINDOW_TYPES = ["<u8", "<u8", "<i8", "<i4", "<i4"]  # two hashes, id, th, start
REQUEST_TYPES = ["<i8", "<i4", "<i4", "u1", "u1"]  # id, th, start, windows, place of the gram


@lru_cache(maxsize=None)
def hashes() -> tuple[RunHash, RunHash]:
    return RunHash(0), RunHash(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = 1
    while 2 * n <= width:
        values, n = np.minimum(values[:-n], values[n:]), 2 * n
    return values if n == width else np.minimum(values[: len(values) - (width - n)], values[width - n :])


def blocks(data: np.ndarray, offsets: np.ndarray, depth: int):
    """Runs of neighbouring windows that agree on the gram they are dealt out by: gram hash, block hash,
    document, place of the first window, number of windows, place of the gram in the first window."""
    by_gram, by_block = hashes()
    none = np.zeros(0, np.int64)
    if len(data) < depth:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    place = np.uint64((1 << 32) - 1)
    prefix = by_gram.prefix(data)
    gram = (prefix[GRAM:] - prefix[:-GRAM]) * by_gram._powers(len(prefix))[1][: len(prefix) - GRAM] * by_gram.finish
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    least = sliding_min((gram & ~place) | np.arange(len(gram), dtype=np.uint64), depth - GRAM + 1)
    at = (least & place).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + depth <= offsets[1:][doc]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    ends = np.ones(len(at), bool)
    ends[:-1] = (at[1:] != at[:-1]) | ~inside[1:]
    first, last = np.flatnonzero(new & inside), np.flatnonzero(ends & inside)
    gram = gram[at[first]]
    prefix = by_block.prefix(data)
    block = by_block.runs(prefix, first, last + depth)
    return gram, block, doc[first], first - offsets[doc[first]], last - first + 1, at[first] - first


def ordered_blocks(gram, block, ids, th, start):
    """Sorts blocks by content and place; tells which have an equal before them, and the group and its
    number of different blocks for each."""
    order = np.lexsort((start, th, ids, block, gram))
    gram, block, ids, th, start = gram[order], block[order], ids[order], th[order], start[order]
    new_gram = C.starts(gram)
    new = new_gram | C.starts(block)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    # a repeated row of one document is that document, not an earlier one
    later = (ids != ids[first]) | (th != th[first]) | (start != start[first])
    group = np.cumsum(new_gram) - 1
    variants = np.bincount(group, weights=new).astype(np.int64)[group] if len(group) else group
    return order, new, later, variants


def find_blocks(depth: int, n: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = bytes_of(part.column("text"))
                gram, block, doc, start, windows, place = blocks(data, offsets, depth)
                ids = part.column("id").to_numpy(zero_copy_only=False)[doc]
                th = part.column("th").to_numpy(zero_copy_only=False)[doc]
                start, windows, place = start.astype("<i4"), windows.astype("u1"), place.astype("u1")
                order, new, later, _ = ordered_blocks(gram, block, ids, th, start)
                keep = order[new]
                bucket = (gram >> np.uint64(40)).astype(np.int64) % n
                sent = keep[np.argsort(bucket[keep], kind="stable")]
                yield C.rows(BLOCK, C.pack(sent, bucket, [gram, block, ids, th, start, windows, place]))
                done = order[later]
                yield spans(ids[done], th[done], start[done], windows[done], depth, lambda key: np.mod(key, n))

    return run


def spans(ids, th, start, windows, depth: int, where, key: str = "bucket") -> pa.RecordBatch:
    """Packed covered intervals, merged for each document."""
    return packed_spans(ids, th, start, start.astype(np.int64) + windows + (depth - 1), where, key)


def packed_spans(ids, th, start, stop, where, key: str) -> pa.RecordBatch:
    return C.rows(SPAN, pack_spans(ids, th, start, stop, where), key)


def pack_spans(ids, th, start, stop, where):
    order = np.lexsort((th, ids))
    ids, th = ids[order], th[order]
    doc = np.cumsum(C.starts(ids, th)) - 1
    first = np.flatnonzero(C.starts(ids, th))
    doc, start, stop = C.merged(start[order], np.asarray(stop)[order], doc)
    ids, th = ids[first][doc], th[first][doc]
    bucket = where(ids)
    order = np.argsort(bucket, kind="stable")
    return C.pack(order, bucket, [ids, th, start.astype("<i4"), stop.astype("<i4")])


def side_by_side(blocks, windows, spans) -> pa.Table:
    """One row for each bucket with what the three kinds of records hold for it: a slice of documents sends each bucket
    one row, whatever it has."""
    kinds = [dict(blocks), dict(windows), dict(spans)]
    buckets = sorted(set().union(*kinds))
    return pa.table({
        "bucket": pa.array(buckets, pa.int32()),
        **{name: pa.array([kind.get(b) for b in buckets], pa.binary()) for name, kind in zip(CUT, kinds, strict=True)},
    })


def held(group: pa.Table, name: str) -> list[bytes]:
    return [payload for payload in group.column(name).to_pylist() if payload is not None]


def settle_blocks(depth: int, n: int):
    """Of equal blocks all but the first are covered; the first is looked at again if its gram has others."""

    def run(group: pa.Table) -> pa.Table:
        gram, block, ids, th, start, windows, place = C.unpack(C.payloads(group, BLOCK), BLOCK_TYPES)
        order, new, later, variants = ordered_blocks(gram, block, ids, th, start)
        done = order[later]
        to_dest = lambda key: C.dest(key, n)
        covered = C.unpack(C.payloads(group, SPAN), SPAN_TYPES)
        found = [ids[done], th[done], start[done], start[done].astype(np.int64) + windows[done] + (depth - 1)]
        ask = order[new & (variants > 1)]
        place[order[variants > MANY]] |= MARK  # a place is below MARK
        bucket = to_dest(ids)
        ask = ask[np.argsort(bucket[ask], kind="stable")]
        return pa.Table.from_batches([
            packed_spans(*[np.concatenate(x) for x in zip(covered, found, strict=True)], to_dest, "dest"),
            C.rows(REQUEST, C.pack(ask, bucket, [ids, th, start, windows, place]), "dest"),
        ])

    return run


def halves(depth: int) -> tuple[int, int]:
    """Bytes to the left of a gram that the windows of the left half hold, and to the right for the others."""
    left = (depth - GRAM) // 2
    return left, depth - GRAM - left + 1


class Windows:
    """Windows of marked blocks, of all documents of a slice."""

    def __init__(self, depth: int):
        self.depth, self.parts = depth, []

    def add(self, body: bytes, ids, th, start, windows) -> None:
        """All windows of the marked blocks of one document."""
        data = np.frombuffer(body, np.uint8)
        begin = np.repeat(start.astype(np.int64) - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        both = [hashed.runs(hashed.prefix(data), begin, begin + self.depth) for hashed in hashes()]
        self.parts.append([*both, np.repeat(ids, windows), np.repeat(th, windows), begin.astype("<i4")])

    def settled(self, n: int):
        """What earlier windows of the slice cover, and the first of each window, packed."""
        found = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, t) for t in WINDOW_TYPES]
        one, later = first_windows(found)
        bucket = (found[0] % np.uint64(n)).astype(np.int64)
        one = one[np.argsort(bucket[one], kind="stable")]
        return covered_by(found, later, self.depth), C.pack(one, bucket, found)


def first_windows(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each window, and those that have an earlier equal."""
    low, high, ids, th, start = found
    order = np.lexsort((start, th, ids, high, low))
    new = C.starts(low[order], high[order])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = (ids[order] != ids[first]) | (th[order] != th[first]) | (start[order] != start[first])
    return order[new], order[later]


def covered_by(found: list[np.ndarray], later: np.ndarray, depth: int) -> list[np.ndarray]:
    _, _, ids, th, start = found
    return [ids[later], th[later], start[later], start[later].astype(np.int64) + depth]


def cut_blocks(depth: int, n: int):
    """Fetches the bytes of the blocks asked for, cut at the gram, and deals them out by their second digit; marked
    blocks are dealt out by whole windows."""
    left, right = halves(depth)
    width = 2 * depth - GRAM

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        ids, th, start, windows, place = C.unpack(C.payloads(asked, REQUEST), REQUEST_TYPES)
        texts = {(i, t): k for k, (i, t) in enumerate(zip(docs.column("id").to_pylist(), docs.column("th").to_pylist(), strict=True))}
        column = docs.column("text")
        order = np.lexsort((th, ids))
        keys, out, bodies = [], [], []
        whole = Windows(depth)
        for own in np.split(order, np.flatnonzero(C.starts(ids[order], th[order]))[1:]) if len(order) else ():
            doc = (int(ids[own[0]]), int(th[own[0]]))
            body = column[texts[doc]].as_py().encode()
            marked = own[place[own] >= MARK]
            if len(marked):
                whole.add(body, ids[marked], th[marked], start[marked], windows[marked].astype(np.int64))
            for k in own[place[own] < MARK].tolist():
                s, w, p = int(start[k]), int(windows[k]), int(place[k])
                gram = s + p
                cut = min(w, max(0, p - left + 1))  # windows 0 .. cut-1 have the whole left digit before the gram
                for first, count, digit in (
                    (0, cut, b"l" + body[gram - left : gram + GRAM]),
                    (cut, w - cut, b"r" + body[gram : gram + GRAM + right]),
                ):
                    if count:
                        keys.append(int.from_bytes(hashlib.blake2b(digit, digest_size=8).digest(), "little"))
                        out.append((doc[0], doc[1], s + first, count, p - first))
                        bodies.append(body[s + first : s + first + count + depth - 1].ljust(width, b"\0"))
        keys = np.array(keys, np.uint64)
        columns = [np.array([o[c] for o in out], t) for c, t in enumerate(REQUEST_TYPES)]
        raw = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, width)
        bucket = (keys % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        covered = C.unpack(C.payloads(asked, SPAN), SPAN_TYPES)
        more, sent = whole.settled(n)
        covered = [np.concatenate(x) for x in zip(covered, more, strict=True)]
        return side_by_side(C.pack(order, bucket, [keys, *columns, raw]), sent, pack_spans(*covered, lambda key: np.mod(key, n)))

    return run


def radix_groups(raw: np.ndarray, row: np.ndarray, begin: np.ndarray, group: np.ndarray, depth: int):
    """Most-significant-digit passes over suffixes ``raw[row, begin:begin + depth]`` of which those of one
    ``group`` may be equal. Returns the suffixes that have an equal, and the number of their class."""
    alive = np.arange(len(row))
    for at in range(-8, depth, 8):
        if at >= 0:
            size = min(8, depth - at)
            digit = np.zeros(len(alive), np.uint64)
            for k in range(size):
                digit = (digit << np.uint64(8)) | raw[row[alive], begin[alive] + at + k]
        else:
            digit = np.zeros(len(alive), np.uint64)
        order = np.lexsort((digit, group))
        new = C.starts(group[order], digit[order])
        number = np.cumsum(new) - 1
        many = (np.bincount(number)[number] > 1) if len(number) else np.zeros(0, bool)
        alive, group = alive[order][many], number[many]
    return alive, group


def sort_suffixes(depth: int, n: int):
    width = 2 * depth - GRAM

    def run(group: pa.Table) -> pa.Table:
        types = ["<u8", *REQUEST_TYPES, ("u1", width)]
        keys, ids, th, start, windows, place, raw = C.unpack(held(group, "blocks"), types)
        row = np.repeat(np.arange(len(keys)), windows)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(windows.astype(np.int64)) - windows, windows)
        # equal windows have the gram at the same place
        relative = place[row].astype(np.int64) - begin
        order = np.lexsort((relative, keys[row]))
        number = np.empty(len(row), np.int64)
        number[order] = np.cumsum(C.starts(keys[row][order], relative[order])) - 1
        alive, klass = radix_groups(raw, row, begin, number, depth)
        r, s = row[alive], start[row[alive]] + begin[alive]
        order = np.lexsort((s, th[r], ids[r], klass))
        r, s, klass = r[order], s[order], klass[order]
        first = np.flatnonzero(C.starts(klass))[klass_number(klass)] if len(klass) else klass
        later = (ids[r] != ids[r[first]]) | (th[r] != th[r[first]]) | (s != s[first])
        r, s = r[later], s[later]
        covered = C.unpack(held(group, "spans"), SPAN_TYPES)
        found = [ids[r], th[r], s.astype("<i4"), s.astype(np.int64) + depth]
        single = C.unpack(held(group, "windows"), WINDOW_TYPES)
        more = covered_by(single, first_windows(single)[1], depth)
        spans_ = [np.concatenate(x) for x in zip(covered, found, more, strict=True)]
        return pa.Table.from_batches([packed_spans(*spans_, lambda key: C.dest(key, n), "dest")])

    return run


def klass_number(klass: np.ndarray) -> np.ndarray:
    return np.cumsum(C.starts(klass)) - 1


def cut_texts(docs: pa.Table, covered: pa.Table) -> pa.Table:
    """Removes the covered bytes of each document."""
    ids, th, start, stop = C.unpack(C.payloads(covered, SPAN), SPAN_TYPES)
    order = np.lexsort((th, ids))
    ids, th, start, stop = ids[order], th[order], start[order], stop[order]
    new = C.starts(ids, th)
    first = np.flatnonzero(new)
    doc, start, stop = C.merged(start, stop, np.cumsum(new) - 1)
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True):
        found.setdefault((int(ids[first[d]]), int(th[first[d]])), []).append((a, b))
    kept, runs, sizes = [], [], []
    keys = list(zip(docs.column("id").to_pylist(), docs.column("th").to_pylist(), strict=True))
    for key, text in zip(keys, docs.column("text"), strict=True):
        body, at, pieces = text.as_py().encode(), 0, []
        for a, b in found.get(key, ()):
            pieces.append(body[at:a])
            at = b
        kept.append(b"".join([*pieces, body[at:]]))
        runs.append([{"start": a, "stop": b} for a, b in found.get(key, ())])
        sizes.append(len(body))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({
        "doc_id": pa.array([None if i == C.NO_ID else i for i, _ in keys], pa.int64()),
        "n_bytes": pa.array(sizes, pa.int64()),
        "removed": pa.array(runs, span),
        "kept": pa.array(kept, pa.binary()),
    })


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 100) -> DataFrame:
    """``doc_id, n_bytes, removed, kept``: every row with its covered byte runs and the bytes that stay.

    A byte goes if a string of ``depth`` bytes covers it that also starts earlier: in a document with a
    smaller id, or further to the front in the same one. ``depth`` lies between 64 and 140.

    Null texts count as empty; texts shorter than ``depth`` keep all bytes. A null id counts as the
    smallest. Rows that repeat an id and its text are the same document and get the same result; rows with
    one id and different texts are ordered by a hash of the text. Other columns are not read.
    """
    if not 64 <= depth <= 140:
        raise ValueError("depth must lie between 64 and 140 bytes")
    n = C.buckets(docs.sparkSession)
    texts = C.keyed(docs, id_col, text_col, n)
    found = texts.select("id", "th", "text").mapInArrow(C.frugal(find_blocks(depth, n)), PACKED)
    settled = found.groupBy("bucket").applyInArrow(settle_blocks(depth, n), DEALT)
    # the two passes over the texts share one exchange
    by_dest = texts.groupBy("dest")
    cut = by_dest.cogroup(settled.groupBy("dest")).applyInArrow(cut_blocks(depth, n), "bucket int, " + ", ".join(f"{c} binary" for c in CUT))
    ordered = cut.groupBy("bucket").applyInArrow(sort_suffixes(depth, n), DEALT)
    return by_dest.cogroup(ordered.groupBy("dest")).applyInArrow(
        cut_texts, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary"
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """``n_removed`` and ``n_spans`` of every document, with a digest of the bytes that stay."""
    found = dedup_substrings(C.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
