"""Language identification by a convolutional network on bytes.

Text is read as fixed-length windows of bytes. Filters of several widths slide over each window, the greatest
response of each filter is kept, and a softmax layer weighs these. The network is trained here, in numpy, on one
window of each of a bounded sample of labelled rows; predictions read every window of the whole text, in batches.
A window counts by its number of letter bytes, and the score is the mean probability of the language chosen.

A filter is a sum of one table lookup per byte it spans, which is the same as a matrix product over embedded bytes
and needs no copy of the windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import common as C
from furrow.llm.bytehash import bytes_of, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
EMBEDDED = 8
# The sample that the network learns from: about so many rows of each language, one window of each; no more rows in
# all, and no more languages, than these.
ROWS_PER_LANGUAGE = 1500
MOST_ROWS = 60_000
MOST_LANGUAGES = 1000
STEPS, BATCH, RATE = 500, 64, 0.01
UNKNOWN = "und"

LETTER = np.zeros(256, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Network:
    """Tables of the filters, ``[width][place in the filter] -> 256 x filters``, and the last layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    last_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for table in self.tables:
            width = len(table)
            long = windows.shape[1] - width + 1
            response = np.take(table[0], windows[:, :long], axis=0)
            for k in range(1, width):
                response += np.take(table[k], windows[:, k : k + long], axis=0)
            out.append(response.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.weights + self.last_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 0) -> Network:
    """Fits the network by Adam on cross-entropy. A part of the windows is shortened at random, so that short
    texts look familiar; a maximum passes its gradient to the place that it came from."""
    rng = np.random.default_rng(seed)
    f, d, classes = FILTERS, EMBEDDED, len(languages)
    p = {"embed": rng.normal(0, 0.5, (256, d)), "bias": np.zeros(f * len(WIDTHS)), "last_bias": np.zeros(classes)}
    for i, w in enumerate(WIDTHS):
        p[f"filter{i}"] = rng.normal(0, (w * d) ** -0.5, (w, d, f))
    p["weights"] = rng.normal(0, 0.1, (f * len(WIDTHS), classes))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(windows), BATCH)
        x, y = windows[pick].copy(), labels[pick]
        for row in np.flatnonzero(rng.random(BATCH) < 0.4).tolist():
            x[row, rng.integers(8, WINDOW) :] = 0
        network = assembled(p, languages)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        places, best = [], []
        for table in network.tables:
            width = len(table)
            long = WINDOW - width + 1
            response = np.take(table[0], x[:, :long], axis=0)
            for k in range(1, width):
                response += np.take(table[k], x[:, k : k + long], axis=0)
            places.append(response.argmax(axis=1))
            best.append(np.take_along_axis(response, places[-1][:, None, :], axis=1)[:, 0])
        raw = np.concatenate(best, axis=1) + p["bias"]
        hidden = np.maximum(raw, 0)
        error = softmax(hidden @ p["weights"] + p["last_bias"])
        error[np.arange(BATCH), y] -= 1
        error /= BATCH
        grad["weights"], grad["last_bias"] = hidden.T @ error, error.sum(axis=0)
        back = (error @ p["weights"].T) * (raw > 0)
        grad["bias"] = back.sum(axis=0)
        for i, width in enumerate(WIDTHS):
            g = back[:, i * f : (i + 1) * f]
            for k in range(width):
                seen = x[np.arange(BATCH)[:, None], places[i] + k]
                grad[f"filter{i}"][k] = np.einsum("bf,bfd->df", g, p["embed"][seen])
                np.add.at(grad["embed"], seen, g[:, :, None] * p[f"filter{i}"][k].T[None])
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = RATE * (1 - step / (STEPS + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            p[k] = (p[k] - move).astype(np.float32)
    return assembled(p, languages)


def assembled(p: dict[str, np.ndarray], languages: list[str]) -> Network:
    tables = [np.einsum("cd,wdf->wcf", p["embed"], p[f"filter{i}"]).astype(np.float32) for i in range(len(WIDTHS))]
    return Network(languages, tables, p["bias"], p["weights"], p["last_bias"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Network:
    """Trains on about ``rows`` rows of each language in ``docs``, chosen by a hash of their id; a language with fewer
    gives all it has. One window of each goes to the driver, at a place that the hash chooses. Rows without text or
    language teach nothing; without any such row the network knows no language.

    What reaches the driver is bounded whatever the table holds: the ``MOST_LANGUAGES`` languages with most rows (ties to
    the first by alphabet), ``MOST_ROWS`` rows shared among them, and at most twice as many where rows repeat an id. Rows
    without an id are chosen by a hash of their text.
    """
    text = F.col(text_col).cast("string").cast("binary")
    known = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text) > 0))
    held = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in held.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(counts)
    if not languages:
        return Network([], [], np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    scale, rows = 1_000_000, max(1, min(rows, MOST_ROWS // len(languages)))
    shares = F.create_map(*[F.lit(v) for name in languages for v in (name, min(scale, -(-rows * scale // counts[name])))])
    row = F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    h = F.xxhash64(row, F.lit("sample"))
    begin = F.lit(1) + F.pmod(F.xxhash64(row, F.lit("place")), F.greatest(F.lit(1), F.octet_length(text) - WINDOW + 1))
    sample = (
        known.where(F.pmod(h, F.lit(scale)) < F.try_element_at(shares, F.col(lang_col)))
        .select(F.col(lang_col).alias("lang"), F.substring(text, begin.cast("int"), F.lit(WINDOW)).alias("bytes"), h.alias("h"))
        .orderBy("h", "lang", "bytes")
        .limit(2 * MOST_ROWS)
        .drop("h")
        .collect()
    )
    sample.sort()
    number = {name: i for i, name in enumerate(languages)}
    windows = np.zeros((len(sample), WINDOW), np.uint8)
    for row, found in zip(windows, sample, strict=True):
        row[: len(found["bytes"])] = np.frombuffer(bytes(found["bytes"]), np.uint8)
    return train(windows, np.array([number[r["lang"]] for r in sample]), languages)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each padded with zeros, and the text of each window."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[doc] + inside * WINDOW
    at = begin[:, None] + np.arange(WINDOW)
    whole = at < offsets[doc + 1][:, None]
    return np.where(whole, data[np.minimum(at, max(0, len(data) - 1))], 0) if len(doc) else np.zeros((0, WINDOW), np.uint8), doc


def predict(network: Network, keep: list[str], text: str):
    """``keep`` columns, then the language and its score of the column ``text``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                data, offsets = bytes_of(part.column(text))
                rows, classes = part.num_rows, len(network.languages)
                name, score = np.full(rows, UNKNOWN, object), np.zeros(rows)
                if classes:
                    windows, doc = windows_of(data, offsets)
                    weight = LETTER[windows].sum(axis=1)
                    total = np.zeros((rows, classes))
                    for first in range(0, len(doc), 256):
                        chosen = slice(first, first + 256)
                        np.add.at(total, doc[chosen], network.probabilities(windows[chosen]) * weight[chosen, None])
                    letters = np.bincount(doc, weights=weight, minlength=rows)
                    some = pc.match_substring_regex(part.column(text).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
                    some &= letters > 0
                    best = total.argmax(axis=1)
                    name[some] = np.array(network.languages, object)[best[some]]
                    score[some] = np.minimum(1, total[some, best[some]] / letters[some])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(name.tolist(), pa.string()), pa.array(score)],
                    names=[*keep, "_lang", "_score"],
                )

    return run


def identify(
    docs: DataFrame, network: Network, text_col: str = "text", lang: str = "lang_pred", score: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs``, all of them by default, and the predicted language with its score, 0 to 1, in two
    more, which take the place of columns so named. Texts that are null or hold no letter, and all texts if the network
    knows no language, are ``und`` with score 0. Each row is predicted on its own; only the text is looked at."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (lang, score)]
    # neutral names on the way through Python, whatever the columns are called
    inner = [f"_{i}" for i in range(len(kept))]
    sent = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    text = "_text"
    if text_col in kept and docs.schema[text_col].dataType == T.StringType():
        sent, text = sent.drop("_text"), inner[kept.index(text_col)]  # the text goes through once
    types = {f.name: f.dataType for f in sent.schema.fields}
    schema = ", ".join(f"`{i}` {types[i].simpleString()}" for i in inner) + ", _lang string, _score double"
    out = sent.mapInArrow(C.frugal(predict(network, inner, text)), schema.lstrip(", "))
    return out.select(*[F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)], F.col("_lang").alias(lang), F.col("_score").alias(score))


def held_out(doc_id: Column) -> Column:
    """True for documents that are kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out, and predicts all."""
    docs = C.table(spark, sf_dir, "documents")
    network = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, network, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
