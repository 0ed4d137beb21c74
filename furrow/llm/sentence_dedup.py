"""Substring dedup on sliding sentence spans.

Every run of several consecutive sentences is hashed: for each sentence the shortest run that starts with it, and the
shortest that ends with it, of at least two sentences and ten words. A run that stands earlier too, in this or another
document, covers its sentences, and covered sentences go. So the first document with a passage keeps it.

A run is 128 bits of hash and a place. Runs are compared first in the task that reads them, then in hash buckets, to
which a task sends one record for each run however often it found it: a passage that a third of all documents hold
comes to as many records as there are slices of documents. Texts are shuffled once, to be cut.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.llm.bytehash import RunHash, bytes_of, mixed, slices
from furrow.llm.ngram_join import SPACE
from furrow.llm.suffix_dedup import DEALT, PACKED, SPAN, SPAN_TYPES, packed_spans

RUN = 0
RUN_TYPES = ["<u8", "<u8", "<i8", "<i4", "<i4", "<i4"]  # two hashes, id, th, first sentence, end of sentences
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


@lru_cache(maxsize=None)
def hashes() -> tuple[RunHash, RunHash]:
    return RunHash(4), RunHash(5)


def sentences(data: np.ndarray, offsets: np.ndarray):
    """``begin, stop, words, first``: bounds and number of words of each sentence, and the number of the first
    sentence of each text (one more entry than texts).

    A sentence ends with ``.``, ``!`` or ``?`` before white space, with a line feed, or with the text; white space
    around it is no part of it, and without a word it is none.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~SPACE[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    stops[:-1] &= ~word[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(len(offsets), np.int64)
    feed = np.concatenate(([0], np.cumsum(data == 10)))
    ends = np.ones(len(begin), bool)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    ends[:-1] = STOP[data[stop[:-1] - 1]] | (feed[begin[1:]] > feed[stop[:-1]]) | (doc[1:] != doc[:-1])
    last = np.flatnonzero(ends)
    first = np.concatenate(([0], last[:-1] + 1))
    return begin[first], stop[last], last - first + 1, np.searchsorted(doc[first], np.arange(len(offsets)))


def runs(data: np.ndarray, offsets: np.ndarray, least: int, words: int):
    """Two hashes, document, first sentence and end of each run, sentences counted within the document."""
    begin, stop, count, first = sentences(data, offsets)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.concatenate(([0], np.cumsum(count)))
    n = len(begin)
    place = np.arange(n)
    until = np.maximum(place + least, np.searchsorted(total, total[:-1] + words))
    forward = until <= first[1:][doc]
    since = np.minimum(place + 1 - least, np.searchsorted(total, total[1:] - words, side="right") - 1)
    backward = since >= first[:-1][doc]
    a = np.concatenate((place[forward], since[backward]))
    b = np.concatenate((until[forward], place[backward] + 1))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = C.starts(a, b)
    a, b = a[new], b[new]
    found = []
    for hashed in hashes():
        each = hashed.runs(hashed.prefix(data), begin, stop)
        up, down = hashed._powers(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * up[:n])))
        found.append(mixed((sums[b] - sums[a]) * down[a] * hashed.finish))
    d = doc[a]
    return found[0], found[1], d, a - first[d], b - first[d]


def ordered_runs(hi, lo, ids, th, first):
    """Sorts runs by content and place; marks the first of each content, and those with an equal before them."""
    order = np.lexsort((first, th, ids, lo, hi))
    new = C.starts(hi[order], lo[order])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = (ids[order] != ids[head]) | (th[order] != th[head]) | (first[order] != first[head])
    return order, new, later


def find_runs(least: int, words: int, n: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = bytes_of(part.column("text"))
                hi, lo, doc, first, end = runs(data, offsets, least, words)
                ids = part.column("id").to_numpy(zero_copy_only=False)[doc]
                th = part.column("th").to_numpy(zero_copy_only=False)[doc]
                first, end = first.astype("<i4"), end.astype("<i4")
                order, new, later = ordered_runs(hi, lo, ids, th, first)
                bucket = (hi >> np.uint64(40)).astype(np.int64) % n
                sent = order[new]
                sent = sent[np.argsort(bucket[sent], kind="stable")]
                yield C.rows(RUN, C.pack(sent, bucket, [hi, lo, ids, th, first, end]))
                done = order[later]
                yield packed_spans(ids[done], th[done], first[done], end[done], lambda key: np.mod(key, n), "bucket")

    return run


def settle_runs(n: int):
    def run(group: pa.Table) -> pa.Table:
        hi, lo, ids, th, first, end = C.unpack(C.payloads(group, RUN), RUN_TYPES)
        order, _, later = ordered_runs(hi, lo, ids, th, first)
        done = order[later]
        covered = C.unpack(C.payloads(group, SPAN), SPAN_TYPES)
        both = [np.concatenate(x) for x in zip(covered, [ids[done], th[done], first[done], end[done]], strict=True)]
        return pa.Table.from_batches([packed_spans(*both, lambda key: C.dest(key, n), "dest")])

    return run


def cut_sentences(docs: pa.Table, covered: pa.Table) -> pa.Table:
    """Removes the covered sentences of each document, with the white space behind them."""
    ids, th, start, stop = C.unpack(C.payloads(covered, SPAN), SPAN_TYPES)
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, t, a, b in zip(ids.tolist(), th.tolist(), start.tolist(), stop.tolist(), strict=True):
        found.setdefault((i, t), []).append((a, b))
    out = {"doc_id": [], "n_sentences": [], "n_removed": [], "kept": []}
    keys = zip(docs.column("id").to_pylist(), docs.column("th").to_pylist(), strict=True)
    for key, text in zip(keys, docs.column("text"), strict=True):
        body = text.as_py().encode()
        data = np.frombuffer(body, np.uint8)
        begin, _, count, _ = sentences(data, np.array([0, len(body)]))
        gone = np.zeros(len(count), bool)
        for a, b in found.get(key, ()):
            gone[a:b] = True
        if gone.any():
            bounds = np.append(begin, len(body)).tolist()
            pieces = [body[: bounds[0]], *(body[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(~gone).tolist())]
            body = b"".join(pieces)
        out["doc_id"].append(None if key[0] == C.NO_ID else key[0])
        out["n_sentences"].append(len(count))
        out["n_removed"].append(int(gone.sum()))
        out["kept"].append(body.decode())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds, strict=True)})


def dedup_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, words: int = 10) -> DataFrame:
    """``doc_id, n_sentences, n_removed, kept``: every row with the text that stays.

    A sentence goes if a run of at least ``least`` sentences and ``words`` words covers it that stands earlier too: in a
    document with a smaller id or further to the front. Null and empty texts have no sentences and stay empty. A null
    id counts as the smallest; rows that repeat an id and its text are the same document and get the same result; rows
    with one id and different texts are ordered by a hash of the text. Other columns are not read.
    """
    n = C.buckets(docs.sparkSession)
    texts = C.keyed(docs, id_col, text_col, n)
    found = texts.select("id", "th", "text").mapInArrow(C.frugal(find_runs(least, words, n)), PACKED)
    settled = found.groupBy("bucket").applyInArrow(settle_runs(n), DEALT)
    return texts.groupBy("dest").cogroup(settled.groupBy("dest")).applyInArrow(
        cut_sentences, "doc_id long, n_sentences long, n_removed long, kept string"
    )


def op2_sentence_dedup(spark, sf_dir: str) -> DataFrame:
    """The document table's sentences, with a digest of the text that stays."""
    found = dedup_sentences(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", "kept", F.sha2("kept", 256).alias("kept_sha256"))
