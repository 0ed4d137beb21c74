"""N-gram Jaccard join in size-banded tiles, with bit counts as an upper bound before exact intersection.

1. **Which documents can link at all.** Two linked sets differ in at most ``d`` shingles, and ``d`` follows
   from the size band of the larger one. Shingles are dealt into more than ``d`` parts by their hash; linked
   sets agree in at least one part as a whole. So each document gives one hash per part and band, and only
   documents that share one with another go on. A part holds several shingles: a common line or passage alone
   makes no candidates. If so many parts of a set are empty that only empty ones may agree, the next seed deals
   anew; two sets that no earlier seed could bring together reach the same seed.
2. **Equal sets.** Documents with equal sets (size and 128 bits of a digest) link without a comparison: one of each
   slice, then one of all, stands for them from here on, so a group of copies is one document in every later step.
3. **Tiles.** Documents that may link form candidate classes (stars, then connected components, never pairs).
   A class is cut into tiles by size band and hash, and pairs of tiles whose sizes fit are compared one after another.
4. **Bounds.** Each set has a bitmap of the parities of its hashed shingles, with at least as many bits as shingles. Two
   sets differ at least by the number of bits in which their bitmaps differ; that bounds the overlap from above. Tiles
   are compared by bitmaps first, 128 bytes for up to 1024 shingles: documents that only share passages part there, before
   any text moves. Tiles of bitmaps are larger than those of texts, and a large band has few of them, so that a document
   comes to few others however many are alike.
5. **Exact.** What may still link is tiled again, with texts, and intersected exactly, as sorted arrays. Documents
   already in one class are not compared again.

The result has one row per document with its class: links between different texts are all found, copies are
not expanded into pairs.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.llm.bytehash import RunHash, bytes_of, mixed, slices
from furrow.llm.components import connected_components
from furrow.session import stored

PACKED = "bucket int, kind int, payload binary"
PART, EDGE, SIZE, SAME, WHOLE = range(5)
PART_TYPES = ["<u4", "<u2", "<i8"]  # 48 bits of a part's hash, id
EDGE_TYPES = ["<i8", "<i8"]
BITS = 1024
SIZE_TYPES = ["<i8", "<i4"]  # id, number of shingles
WHOLE_TYPES = ["<u8", "<u8", "<i8", "<i4"]  # digest of a set, id, number of shingles; a bitmap comes after them
MOST_BITS = 1 << 16
LEVELS = BITS << np.arange((MOST_BITS // BITS).bit_length())  # lengths of bitmaps; records of level k are of kind WHOLE + k
SEEDS = 12  # after so many seeds sets with empty parts also meet in those
TILE = 1500  # documents in a tile
SHINGLES = 2_000_000  # and shingles, on average
BIT_TILE = 32_768  # most bitmaps in a tile
BIT_SHINGLES = 16 * SHINGLES  # and shingles of their sets: some 8 MB
FEW = 500  # rows of small pairs that are compared in one call
FEW_BYTES = 8 << 20  # and their bytes, about
AT_ONCE = 1 << 20  # elements of sets that are laid side by side at a time

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=None)
def word_hash() -> RunHash:
    return RunHash(2)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, laid end to end, and the n + 1 offsets.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
    return, with A-Z lower-cased. A text with fewer than ``words`` words has one shingle, one without
    words none.
    """
    data, offsets = bytes_of(texts)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashed = word_hash()
    w = hashed.runs(hashed.prefix(LOWER[data]), begin, stop)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    factor = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64)) for k in range(words)]
    h = np.zeros(len(w), np.uint64)
    for k in range(words):
        end = max(0, len(w) - k)
        h[:end] += w[k:] * factor[k]
    whole = np.arange(len(w)) + words <= first[doc + 1]
    short = np.flatnonzero((count > 0) & (count < words))
    for d in short.tolist():
        part = w[first[d] : first[d + 1]]
        h[first[d]] = sum((int(x) * int(f) for x, f in zip(part, factor, strict=False)), len(part)) % 2**64
        whole[first[d]] = True
    h, doc = mixed(h[whole]), doc[whole]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = C.starts(doc, h)
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=n))))


class Bands:
    """Size bands for links where ``den * |intersection| >= num * |union|``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 2**31:
            low.append(max(low[-1] + 1, -(-low[-1] * den // num), low[-1] * 11 // 10))
        self.low = np.array(low, np.int64)
        most = self.low[1:] - 1
        self.differ = 2 * most * (den - num) // (den + num)  # most shingles in which linked sets differ
        need = self.differ + 1
        self.parts = need + need // 16

    def of(self, size):
        return np.searchsorted(self.low, size, side="right") - 1

    def largest(self, size):
        """Size of the largest set that a set can link with."""
        return size * self.den // self.num

    def overlap(self, total):
        """Least overlap of linked sets whose sizes add up to ``total``."""
        return -(-self.num * total // (self.num + self.den))


def digests(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two columns."""
    each = [hashlib.blake2b(values[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(each), "<u8").reshape(-1, 2)


def part_keys(bands: Bands, values: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | bool = True):
    """Hashes of the parts of each ``wanted`` set, ``key, doc``."""
    size = np.where(wanted, np.diff(offsets), 0)
    own, last = bands.of(size), bands.of(bands.largest(size))
    keys, docs = [], []
    for step in range(int((last - own)[size > 0].max(initial=-1)) + 1):
        chosen = np.flatnonzero((size > 0) & (own + step <= last))
        band = own[chosen] + step
        seed = 0
        while len(chosen):
            take, row = expand(offsets, chosen)
            v = values[take]
            if seed:
                v = mixed(v + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
                order = np.lexsort((v, row))
                v, row = v[order], row[order]
            part = (((v >> np.uint64(32)) * bands.parts[band].astype(np.uint64)[row]) >> np.uint64(32)).astype(np.int64)
            new = np.flatnonzero(C.starts(row, part))
            total = np.add.reduceat(mixed(v ^ np.uint64(0xA5A5A5A5A5A5A5A5)), new)
            row, part = row[new], part[new]
            keys.append(part_key(total, part, band[row], seed))
            docs.append(chosen[row])
            few = np.bincount(row, minlength=len(chosen)) <= bands.differ[band]
            chosen, band, seed = chosen[few], band[few], seed + 1
            if seed == SEEDS and len(chosen):
                # what is left meets in a part of its own for each band
                keys.append(part_key(np.zeros(len(chosen), np.uint64), np.zeros(len(chosen), np.int64), band, seed))
                docs.append(chosen)
                break
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs)


def part_key(total, part, band, seed: int) -> np.ndarray:
    place = (part.astype(np.uint64) << np.uint64(20)) + (band.astype(np.uint64) << np.uint64(8)) + np.uint64(seed)
    return mixed(total + mixed(place * np.uint64(0x9E3779B97F4A7C15)))


def expand(offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all elements of the chosen sets, and which of the chosen each belongs to."""
    size = offsets[chosen + 1] - offsets[chosen]
    row = np.repeat(np.arange(len(chosen)), size)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return offsets[chosen][row] + inside, row


def in_parts(size: np.ndarray, most: int = AT_ONCE):
    """Ranges ``first, last`` of sets with at most ``most`` elements together; a larger set stands alone."""
    ends, first = np.cumsum(size), 0
    while first < len(size):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, last
        first = last


def stars(ids: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First record of each key, and the edges from its id to the other ids of the key."""
    order = np.lexsort((ids, *key))
    ids = ids[order]
    new = C.starts(*[k[order] for k in key])
    hub = ids[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(ids) else ids
    other = hub != ids
    return order[new], hub[other], ids[other]


def unique_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = C.starts(a, b)
    return a[new], b[new]


def deal_parts(words: int, bands: Bands, n: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                ids = piece.column("id").to_numpy(zero_copy_only=False)
                values, offsets = shingle_sets(piece.column("text"), words)
                size, whole = np.diff(offsets).astype("<i4"), digests(values, offsets)
                some = np.flatnonzero(size)
                first, a, b = stars(ids[some], whole[some, 0], whole[some, 1], size[some])
                one = some[first]
                a, b = unique_edges(a, b)
                where = np.mod(a, n)
                yield C.rows(SAME, C.pack(np.argsort(where, kind="stable"), where, [a, b]))
                where = (whole[one, 0] % np.uint64(n)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                for k in np.unique(levels(size[one])).tolist():
                    own = order[levels(size[one[order]]) == k]
                    rows = one[own]
                    sets = [whole[rows, 0], whole[rows, 1], ids[rows], size[rows], bitmaps(values, offsets, rows, int(LEVELS[k])).view(np.uint8)]
                    yield C.rows(WHOLE + k, C.pack(np.arange(len(own)), where[own], sets))
                wanted = np.zeros(len(ids), bool)
                wanted[one] = True
                key, doc = part_keys(bands, values, offsets, wanted)
                first, a, b = stars(ids[doc], key)
                bucket = (key >> np.uint64(48)).astype(np.int64) % n
                order = first[np.argsort(bucket[first], kind="stable")]
                low, high = (key & np.uint64(0xFFFFFFFF)).astype("<u4"), ((key >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2")
                yield C.rows(PART, C.pack(order, bucket, [low, high, ids[doc]]))
                a, b = unique_edges(a, b)
                where = np.mod(a, n)
                yield C.rows(EDGE, C.pack(np.argsort(where, kind="stable"), where, [a, b]))
                where = np.mod(ids, n)
                yield C.rows(SIZE, C.pack(np.argsort(where, kind="stable"), where, [ids, size]))

    return run


def meet_parts(group: pa.Table) -> pa.Table:
    """Edges between documents that share a part, and between those of equal sets; the sizes passed on; the document
    that stands for each set."""
    low, high, ids = C.unpack(C.payloads(group, PART), PART_TYPES)
    _, a, b = stars(ids, low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
    a2, b2 = C.unpack(C.payloads(group, EDGE), EDGE_TYPES)
    a, b = unique_edges(np.concatenate((a, a2)), np.concatenate((b, b2)))
    same, sets, bits = [C.unpack(C.payloads(group, SAME), EDGE_TYPES)], [[np.zeros(0, np.int64)] * 2], []
    kinds = set(group.column("kind").to_pylist())
    # equal sets have bitmaps of one length
    for k, length in enumerate(LEVELS.tolist()):
        if WHOLE + k not in kinds:
            continue
        low, high, ids, shingles, own = C.unpack(C.payloads(group, WHOLE + k), [*WHOLE_TYPES, ("u1", length // 8)])
        one, same_a, same_b = stars(ids, low, high, shingles)
        same.append([same_a, same_b])
        sets.append([ids[one], shingles[one].astype(np.int64)])
        bits += [row.tobytes() for row in own[one]]
    same_a, same_b = unique_edges(*(np.concatenate(c) for c in zip(*same, strict=True)))
    ids, shingles = (np.concatenate(c) for c in zip(*sets, strict=True))
    doc, size = C.unpack(C.payloads(group, SIZE), SIZE_TYPES)
    return pa.table({
        "kind": pa.array(np.repeat(np.array([EDGE, SAME, SIZE, WHOLE], np.int32), [len(a), len(same_a), len(doc), len(ids)])),
        "a": pa.array(np.concatenate((a, same_a, doc, ids))),
        "b": pa.array(np.concatenate((b, same_b, size.astype(np.int64), shingles))),
        "bits": pa.array([None] * (len(a) + len(same_a) + len(doc)) + bits, pa.binary()),
    })


def in_turn(compare):
    """Calls ``compare`` with whole pairs of tiles from batches in order of ``pair``: with one pair, or with small ones
    up to ``FEW`` rows or ``FEW_BYTES`` before the last of them."""

    def called(held):
        group = pa.Table.from_batches(held)
        large = group.nbytes > FEW_BYTES
        yield from compare(group).to_batches()
        if large:
            del group
            held.clear()
            C.release()

    def run(batches):
        held, rows, taken, last = [], 0, 0, None
        for batch in batches:
            begin, ends = 0, row_ends(batch)
            for k, pair in enumerate(batch.column("pair").to_pylist()):
                if pair != last and (rows + k - begin >= FEW or taken + ends[k] - ends[begin] >= FEW_BYTES):
                    ready, held, rows, taken = [*held, batch.slice(begin, k - begin)], [], 0, 0
                    begin = k
                    yield from called(ready)
                last = pair
            held.append(batch.slice(begin))
            rows, taken = rows + len(batch) - begin, taken + ends[-1] - ends[begin]
        if rows:
            yield from called(held)

    return run


def row_ends(batch: pa.RecordBatch) -> list[int]:
    """The n + 1 offsets of the rows' texts, or zeros where they have none."""
    if "text" not in batch.schema.names:
        return [0] * (len(batch) + 1)
    return bytes_of(batch.column("text"))[1].tolist()


def by_pair(group: pa.Table, size: np.ndarray, classes) -> pa.Table:
    """Edges from the least id of each class that ``classes(rows, side)`` finds in a pair of tiles; rows come in
    order of size."""
    side, ids = group.column("side").to_numpy(), group.column("id").to_numpy()
    pair = group.column("pair").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((size, pair))
    cuts = np.searchsorted(pair[order], np.arange(int(pair.max(initial=-1)) + 2))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[first:last]
        label = classes(rows, side[rows])
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids[rows])
        root = least[label]
        other = root != ids[rows]
        a.append(root[other])
        b.append(ids[rows][other])
    a, b = unique_edges(np.concatenate(a), np.concatenate(b))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def compare_bitmaps(bands: Bands):
    """Links that the bitmaps do not rule out."""

    def run(group: pa.Table) -> pa.Table:
        size, bits = group.column("size").to_numpy(), group.column("bits").combine_chunks()

        def classes(rows, side):
            return link(bands, size[rows], side, folded(bands, size[rows], bits.take(pa.array(rows))), None)

        return by_pair(group, size, classes)

    return run


def folded(bands: Bands, size: np.ndarray, bits: pa.Array):
    """Counts the bits in which a set differs from larger ones; sets are in order of size. The bitmap of a larger set is
    folded to the length of the smaller one's: the parities of bits that fall together are added."""
    reach, level, data = np.searchsorted(size, bands.largest(size), side="right"), levels(size), bytes_of(bits)[0]
    cuts = np.searchsorted(level, np.arange(len(LEVELS) + 1))
    ends = np.concatenate(([0], np.cumsum(LEVELS[level] // 8)))
    planes = {}
    for k in np.unique(level).tolist():
        upto, width = int(reach[cuts[k] : cuts[k + 1]].max(initial=cuts[k + 1])), int(LEVELS[k]) // 64
        parts = []
        for j in range(k, len(LEVELS)):
            first, last = int(min(cuts[j], upto)), int(min(cuts[j + 1], upto))
            if first < last:
                own = data[ends[first] : ends[last]].view(np.uint64).reshape(last - first, -1, width)
                parts.append(np.bitwise_xor.reduce(own, axis=1))
        planes[k] = cuts[k], np.concatenate(parts)

    def differ(i, others):
        first, plane = planes[int(level[i])]
        return differing(plane, i - first, others - first)

    return differ


def differing(bitmap: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmap[others] ^ bitmap[i]).sum(axis=1, dtype=np.int64)


def compare_texts(words: int, bands: Bands):
    """Links between documents, by the intersection of their sets."""

    def run(group: pa.Table) -> pa.Table:
        parts, total = [], 0
        offsets = [np.zeros(1, np.int64)]
        for batch in group.select(["text"]).to_batches():
            for piece in slices(batch, "text"):
                values, ends = shingle_sets(piece.column("text"), words)
                parts.append(values)
                offsets.append(ends[1:] + total)
                total += len(values)
        values, offsets = np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate(offsets)
        parts.clear()
        size = np.diff(offsets)

        def classes(rows, side):
            def overlap(i, others):
                mine, common = values[offsets[rows[i]] : offsets[rows[i] + 1]], []
                for first, last in in_parts(size[rows[others]]):
                    take, row = expand(offsets, rows[others[first:last]])
                    theirs = values[take]
                    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    common.append(np.bincount(row, weights=mine[at] == theirs, minlength=last - first))
                return np.concatenate(common)

            bitmap = bitmaps(values, offsets, rows, int(LEVELS[levels(size[rows]).max(initial=0)]))
            return link(bands, size[rows], side, partial(differing, bitmap), overlap)

        return by_pair(group, size, classes)

    return run


def bitmaps(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of the hashed shingles of each set, ``bits`` of them, which is a power of two."""
    out = np.zeros((len(rows), bits // 64), np.uint64)
    for first, last in in_parts(np.maximum(offsets[rows + 1] - offsets[rows], bits)):
        part = rows[first:last]
        take, row = expand(offsets, part)
        place = row * bits + (values[take] & np.uint64(bits - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=len(part) * bits) & 1).astype(np.uint8)
        out[first:last] = np.packbits(odd.reshape(len(part), bits), axis=1).view(np.uint64)
    return out


def levels(size: np.ndarray) -> np.ndarray:
    """Place in ``LEVELS`` of the bits that tell unrelated sets of this size apart: at least as many as shingles."""
    return np.minimum(np.searchsorted(LEVELS, size), len(LEVELS) - 1)


def link(bands: Bands, size: np.ndarray, side: np.ndarray, differ, overlap) -> np.ndarray:
    """Class of each set, in order of size; sets on sides 1 and 2 are compared with the other side only, those on
    side 0 with all. ``differ`` counts the bits in which one set's bitmap differs from others. Without ``overlap``, which
    measures one set against others, what the bitmaps allow counts."""
    n = len(size)
    label = np.arange(n)
    if n < 2 or size[-1] == 0:
        return label
    reach = np.searchsorted(size, bands.largest(size), side="right")
    for i in range(int(np.searchsorted(size, 1)), n - 1):
        other = np.arange(i + 1, reach[i])
        other = other[(label[other] != label[i]) & ((side[other] != side[i]) | (side[i] == 0))]
        if not len(other):
            continue
        total = size[i] + size[other]
        need = bands.overlap(total)
        could = differ(i, other) <= total - 2 * need
        other, need = other[could], need[could]
        if overlap is not None and len(other):
            other = other[overlap(i, other) >= need]
        if len(other):
            found = np.append(label[other], label[i])
            label[np.isin(label, found)] = found.min()
    return label


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: each row with the size of its set of ``words``-word shingles and the
    least id that it reaches by links. Two documents link when ``den * |intersection| >= num * |union|``.

    Null and empty texts have no shingles and link with nothing. A null id counts as the smallest id. Rows that
    repeat an id are one node: each has its own ``n_shingles``, a link of any of them counts for all. Other columns
    are not read. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    n = C.buckets(spark)
    bands = Bands(num, den)
    texts = docs.select(C.key_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = texts.mapInArrow(C.frugal(deal_parts(words, bands, n)), PACKED)
    met = stored(dealt.groupBy("bucket").applyInArrow(meet_parts, "kind int, a long, b long, bits binary"))
    sizes = met.where(F.col("kind") == SIZE).select(F.col("a").alias("id"), F.col("b").alias("size"))
    same = met.where(F.col("kind") == SAME).select("a", "b")
    # only documents that stand for a set are tiled
    bits = met.where(F.col("kind") == WHOLE).select(F.col("a").alias("id"), F.col("b").alias("size"), "bits")
    largest = bits.groupBy("id").agg(F.max("size").alias("size"))

    def compared(pieces, compare):
        sorted_pieces = pieces.repartition("pair").sortWithinPartitions("pair")
        return sorted_pieces.mapInArrow(C.frugal(in_turn(compare)), "a long, b long")

    classes = connected_components(met.where(F.col("kind") == EDGE).select("a", "b"))
    tiles = _tiles(classes, largest, bands, BIT_TILE, BIT_SHINGLES)
    pieces = bits.join(tiles, "id").select("pair", "side", "id", "size", "bits")
    classes = connected_components(compared(pieces, compare_bitmaps(bands)))
    tiles = _tiles(classes, largest, bands, TILE, SHINGLES)
    # a merge join at every size: texts move once, tiles are as many as documents that may link
    pieces = texts.join(tiles.hint("merge"), "id").select("pair", "side", "id", "text")
    # an id with several texts is one node of several sets, so its links to them are links like others
    several = sizes.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    first = same.join(several, same["b"] == several["id"], "left_semi")
    above = same.join(first.select(F.col("a").alias("up")), F.col("b") == F.col("up"), "left_semi")
    found = connected_components(compared(pieces, compare_texts(words, bands)).union(first).union(above))
    joined = sizes.join(_with_copies(found, same), "id", "left")
    own = lambda c: F.when(c != C.NO_ID, c)
    return joined.select(
        own(F.col("id")).alias("doc_id"),
        F.col("size").alias("n_shingles"),
        own(F.coalesce("component", "id")).alias("component_id"),
    )


def _with_copies(found: DataFrame, same: DataFrame) -> DataFrame:
    """``id, component`` of the documents that stand for sets, and of their copies.

    Copies of a slice of documents hang on the first one there, and that one on the first of the whole table, so two
    joins reach all; no group is larger than the copies in a slice or the slices of the table.
    """
    here = same.join(found, F.col("a") == F.col("id"), "left").select("a", "b", F.coalesce("component", "a").alias("near"))
    here = stored(here)
    above = here.select(F.col("b").alias("up"), F.col("near").alias("far"))
    copies = here.join(above, F.col("a") == F.col("up"), "left").select(F.col("b").alias("id"), F.coalesce("far", "near").alias("component"))
    return found.union(copies).groupBy("id").agg(F.min("component").alias("component"))


def _tiles(classes: DataFrame, sizes: DataFrame, bands: Bands, most: int, shingles: int) -> DataFrame:
    """``id, pair, side``: the pairs of tiles that each document of a candidate class takes part in.

    A class of at most ``TILE`` documents and ``shingles`` shingles is one tile. A larger one is cut by size band, and a
    band by hash, into four tiles where these have from ``TILE`` up to ``most`` documents; a tile meets itself, the other
    tiles of its band and those of the next band. A document that is alone in its class is in no tile.
    """
    low = [int(x) for x in bands.low]
    # the band by search in a constant array: the number of edges not above the size
    edges = F.array(*[F.lit(x) for x in low])
    band = F.size(F.filter(edges, lambda e: e <= F.col("size")))
    members = stored(classes.join(sizes, "id").withColumn("band", band))
    counts = members.groupBy("component", "band").agg(F.count("*").alias("docs"), F.sum("size").alias("shingles"))
    # one row per band, at most some hundred for a class
    of_class = Window.partitionBy("component")
    by_band = of_class.orderBy("band")
    tile = F.greatest(F.lit(TILE), F.least(F.lit(most), F.ceil(F.col("docs") / 4)))
    splits = F.ceil(F.greatest(F.col("docs") / tile, F.least(F.col("docs"), F.col("shingles") / shingles))).cast("int")
    counts = (
        counts.withColumn("splits", splits)
        .withColumn("all_docs", F.sum("docs").over(of_class))
        .withColumn("all_shingles", F.sum("shingles").over(of_class))
        .where("all_docs > 1")
        .withColumn("next", F.when(F.lead("band").over(by_band) == F.col("band") + 1, F.lead("splits").over(by_band)).otherwise(0))
        .withColumn("before", F.when(F.lag("band").over(by_band) == F.col("band") - 1, F.lag("splits").over(by_band)).otherwise(0))
    )
    dealt = members.join(counts.drop("docs", "shingles"), ["component", "band"])
    split = F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")

    def pairs(lo_band, lo, hi_band, hi, side):
        name = F.concat_ws("/", F.col("component"), lo_band, lo, hi_band, hi)
        return F.struct(name.alias("pair"), side.cast("int").alias("side"))

    def upto(c):
        return F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))

    b = F.col("band")
    own = F.transform(
        upto(F.col("splits")),
        lambda j: pairs(
            b, F.least(F.col("split"), j), b, F.greatest(F.col("split"), j),
            F.when(j == F.col("split"), 0).when(F.col("split") < j, 1).otherwise(2),
        ),
    )
    above = F.transform(upto(F.col("next")), lambda j: pairs(b, F.col("split"), b + 1, j, F.lit(1)))
    below = F.transform(upto(F.col("before")), lambda j: pairs(b - 1, j, b, F.col("split"), F.lit(2)))
    whole = F.array(F.struct(F.col("component").cast("string").alias("pair"), F.lit(0).alias("side")))
    chosen = F.when((F.col("all_docs") <= TILE) & (F.col("all_shingles") <= shingles), whole).otherwise(F.concat(own, above, below))
    return dealt.withColumn("split", split).select("id", F.explode(chosen).alias("p")).select("id", "p.pair", "p.side")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles and a similarity of 0.85."""
    return ngram_join(C.table(spark, sf_dir, "documents"), words=4, num=85, den=100)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP9_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.y) AS component_id FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY 1, 2
"""
