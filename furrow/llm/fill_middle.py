"""Fill-in-the-middle: texts are cut in three and written with the middle last.

A batch of texts is one run of bytes. The scan for cuts finds where units start; the two cuts of a text part it into
prefix, middle and suffix. In the output each of the three lies at another place, so every byte has a displacement,
and it only changes at the start of a part: a difference array holds the changes, its cumulative sum is the
displacement of every byte, and one scatter writes them all; the marks go to the places left free. The way back finds
the marks in the output, sums up displacements again and gathers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.llm.bytehash import bytes_of, slices

# Marks of prefix, suffix and middle, forms by number, shares in percent and the salt of the hash.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
PLAIN_FROM, SPM_BELOW, SALT = 90, 20, "1:"
# Order of the parts in the output: prefix 0, middle 1, suffix 2.
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
MARK_OF = (0, 2, 1)
SLICE = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True

PLACED = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


def checked(marks: tuple[str, str, str]) -> list[bytes]:
    """Marks as bytes. They are of the kind ``<..>`` and differ, so that no text without them can make one with a
    neighbouring mark."""
    for mark in marks:
        if len(mark) < 3 or mark[0] != "<" or mark[-1] != ">" or set(mark[1:-1]) & set("<>") or not mark.isascii():
            raise ValueError(f"a mark is of the kind <..>, not {mark!r}")
    if len(set(marks)) < 3 or len({len(m) for m in marks}) > 1:
        raise ValueError("marks differ and have one length")
    return [m.encode() for m in marks]


def marked(data: np.ndarray, ends: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, document and number of every mark in the bytes of documents that end at ``ends``."""
    width = len(marks[0])
    at = np.flatnonzero(data[: max(0, len(data) - width + 1)] == marks[0][0])
    doc = np.searchsorted(ends, at, side="right")
    whole = at + width <= ends[doc]
    at, doc = at[whole], doc[whole]
    number = np.full(len(at), -1)
    for k, mark in enumerate(marks):
        same = np.ones(len(at), bool)
        for j, byte in enumerate(mark):
            same &= data[at + j] == byte
        number[same] = k
    found = number >= 0
    return at[found], doc[found], number[found]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True where a code point starts, and the places where a unit starts: a run of letters or another code point."""
    point = (data & 0xC0) != 0x80
    letter = LETTER[data]
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    begins = offsets[:-1]
    inside[begins[begins < len(data)]] = False
    return point, np.flatnonzero(point & ~inside)


def shifted(places: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """Displacement of each of ``n`` bytes, where the part that starts at ``places[i]`` is moved by ``shifts[i]``.

    ``places`` ascend; of parts that start at one place all but the last are empty.
    """
    jump = np.diff(shifts, prepend=0)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, jump)
    return np.cumsum(change[:-1])


def rearranged(data, offsets, h: list[np.ndarray], marks: list[bytes]):
    """Bytes and offsets of the outputs, number of units, form, and code points of prefix and middle."""
    docs, width = len(offsets) - 1, len(marks[0])
    point, unit = units(data, offsets)
    first = np.searchsorted(unit, offsets)
    n = np.diff(first)
    form = np.where(h[3] % 100 < SPM_BELOW, SPM, PSM)
    form[(n == 0) | (h[2] % 100 >= PLAIN_FROM)] = PLAIN
    form[marked(data, offsets[1:], marks)[1]] = PLAIN
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    # a cut behind the last unit is the first unit of the next text, or the end
    unit = np.append(unit, len(data))
    cut_a, cut_b = (np.minimum(unit[first[:-1] + c], offsets[1:]) for c in (np.minimum(a, b), np.maximum(a, b)))
    parts = np.stack([offsets[:-1], cut_a, cut_b], axis=1)  # where prefix, middle and suffix start
    sizes = np.diff(np.concatenate([parts, offsets[1:, None]], axis=1), axis=1)
    out_sizes = np.diff(offsets) + np.where(form == PLAIN, 0, 3 * width)
    out_offsets = np.concatenate(([0], np.cumsum(out_sizes)))
    to = np.zeros((docs, 3), np.int64)  # where they start in the output
    plain = form == PLAIN
    to[plain] = parts[plain] - offsets[:-1][plain, None] + out_offsets[:-1][plain, None]
    out = np.empty(int(out_offsets[-1]), np.uint8)
    for kind, order in ORDER.items():
        rows = np.flatnonzero(form == kind)
        place = out_offsets[:-1][rows]
        for part in order:
            for j, byte in enumerate(marks[MARK_OF[part]]):
                out[place + j] = byte
            to[rows, part] = place + width
            place = place + width + sizes[rows, part]
    out[np.arange(len(data)) + shifted(parts.ravel(), (to - parts).ravel(), len(data))] = data
    count = np.concatenate(([0], np.cumsum(point)))
    return out, out_offsets, n, form, count[cut_a] - count[offsets[:-1]], count[cut_b] - count[cut_a]


def restored(out, out_offsets, form: np.ndarray, marks: list[bytes]):
    """Bytes and offsets of the texts that the outputs were made of."""
    docs, width = len(out_offsets) - 1, len(marks[0])
    plain = form == PLAIN
    at, doc, number = marked(out, out_offsets[1:], marks)
    use = ~plain[doc]
    at, doc, number = at[use], doc[use], number[use]
    if not np.array_equal(np.bincount(doc, minlength=docs), np.where(plain, 0, 3)):
        raise ValueError("an output that is not plain has each mark once")
    offsets = np.concatenate(([0], np.cumsum(np.diff(out_offsets) - np.where(plain, 0, 3 * width))))
    # where each part starts and how long it is in the output; the next mark or the end ends it
    begin, size = np.zeros((docs, 3), np.int64), np.zeros((docs, 3), np.int64)
    stop = np.append(at[1:], 0)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    stop[last] = out_offsets[1:][doc[last]]
    part = np.array([MARK_OF.index(k) for k in range(3)])[number]
    begin[doc, part], size[doc, part] = at + width, stop - at - width
    begin[plain, 0] = out_offsets[:-1][plain]
    size[plain, 0] = np.diff(out_offsets)[plain]
    to = offsets[:-1, None] + np.cumsum(size, axis=1) - size
    total = int(offsets[-1])
    return out[np.arange(total) + shifted(to.ravel(), (begin - to).ravel(), total)], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def placed(marks: list[bytes]):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                data, offsets = bytes_of(piece.column("text"))
                h = [piece.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)]
                out, places, n, form, prefix, middle = rearranged(data, offsets, h, marks)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"), pa.array(n, pa.int64()), pa.array(np.array(FORMS)[form]), pa.array(prefix, pa.int64(), mask=plain),
                        pa.array(middle, pa.int64(), mask=plain), strings(out, places),
                    ],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def gathered(marks: list[bytes], keep: list[str]):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, "_output", SLICE):
                out, places = bytes_of(piece.column("_output"))
                names = np.array(piece.column("_form").fill_null(FORMS[PLAIN]).to_pylist(), object)
                form = np.select([names == FORMS[PSM], names == FORMS[SPM]], [PSM, SPM], PLAIN)
                data, offsets = restored(out, places, form, marks)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], strings(data, offsets)], names=[*keep, "_text"])

    return run


def draws(id_col: str, salt: str = SALT) -> list[Column]:
    """Four numbers below 2**32 for each document: the first four groups of eight digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, salt: str = SALT) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output``: one row for each row of ``docs``.

    A text has ``n`` units, runs of ASCII letters and single other code points. Cuts and form follow from a hash of
    the salt and the id alone, so rows that repeat an id and a text come out alike; a null id hashes the salt alone.
    Null counts as empty. Empty texts and texts that hold a mark stay plain, and then have no prefix or middle. Other
    columns are not read. An empty table gives no rows. A text is held whole by one task, with some 60 times its bytes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    asked = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *draws(id_col, salt))
    return asked.mapInArrow(placed(checked(marks)), PLACED)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", text: str = "text", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All columns of ``rows``, and in ``text`` the text that each output was made of, in place of a column so named.

    A null output restores the empty text, and a null or unknown form counts as plain. An output that is not plain
    and lacks a mark, or has one twice, is an error.
    """
    kept = [c for c in rows.columns if c != text]
    names = {f"c{k}": c for k, c in enumerate(kept)}
    inner = rows.select(
        *[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.col(f"`{output_col}`").alias("_output"), F.col(f"`{form_col}`").cast("string").alias("_form")
    )
    schema = ", ".join([*[f"{k} {inner.schema[k].dataType.simpleString()}" for k in names], "_text string"])
    found = inner.mapInArrow(gathered(checked(marks), list(names)), schema)
    return found.select(*[F.col(k).alias(c) for k, c in names.items()], F.col("_text").alias(text))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Every document cut and rearranged, and restored from its output and form alone."""
    cut = fill_middle(C.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    known = cut.withColumn("output_sha256", digest("output"))
    return restore(known).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", digest("text").alias("restored_sha256")
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, body, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS units,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
p AS (
  SELECT doc_id, n, form, body, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""
