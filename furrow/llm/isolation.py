"""Quality rules, and an isolation forest on what they count.

One pass over the texts counts what rules look at: words, symbols, repeated lines, words in repeated windows and the
like. A forest of random trees is grown on these statistics of rows labelled good, each tree on a small sample: a node
draws a statistic and a value in the range of its rows, and rows that few splits part from all others are anomalous. The
range is widened a little, as far as labelled rows of either kind reach, since a statistic that never varies among good
rows would otherwise never be drawn. A row's score is ``2 ** (-mean path length / expected length)``, as published for
isolation forests. Where the border between ordinary and anomalous scores lies is not guessed: it is the least score
that no more than a given share of the rows labelled good reaches, counted over all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.llm.bytehash import RunHash, bytes_of, mixed, slices
from furrow.session import stored

# Fixed values of the base rule: least words, words of a window, and the percentage of words in repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
# Labelled rows that the forest is grown on at most, trees, and rows of a tree.
SAMPLE, TREES, TREE_ROWS = 4096, 100, 256
# By how much of the whole range a node's range is widened on each side.
MARGIN = 0.2
# Share of the rows labelled good that may reach the border, and the steps in which scores are counted to find it.
FALSE_SHARE, STEPS = 0.002, 4096
SLICE = 1 << 20

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_twin_words", "n_upper", "n_lower", "n_digits", "n_marks",
]


def class_of(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE, SYMBOL = class_of(b"\x20\x09\x0a\x0b\x0c\x0d"), class_of(b"#*$%&|<>")
UPPER, LOWER, DIGIT = class_of(range(65, 91)), class_of(range(97, 123)), class_of(range(48, 58))
MARK = class_of(range(33, 127)) & ~UPPER & ~LOWER & ~DIGIT


# Odd factors of the words of a window, for each of two hashes; from a fixed seed, so that all tasks agree.
FACTORS = np.random.default_rng(12).integers(0, 2**64, (2, WINDOW), dtype=np.uint64) | np.uint64(1)


class Sums:
    """Sums of flags over the rows of ``offsets``."""

    def __init__(self, offsets: np.ndarray):
        self.offsets = offsets

    def __call__(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def equal_before(doc: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal items of a document together, and True where one equals the one before it there.

    Items are equal when both of their hashes, 128 bits, agree.
    """
    order = np.argsort(mixed(first + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    return order, ~C.starts(doc[order], first[order], second[order])


def counted(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text in a run of bytes."""
    docs, per_doc = len(offsets) - 1, Sums(offsets)
    space = SPACE[data]
    prefixes = [(hashed, hashed.prefix(data)) for hashed in (RunHash(0), RunHash(1))]

    # words: a start after white space or the text's begin, an end before white space or the text's end
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~space & (edge[:-1] | np.append(True, space)[:-1]))
    stop = np.flatnonzero(~space & (edge[1:] | np.append(space, True)[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(doc, minlength=docs)
    names = [hashed.runs(prefix, start, stop) for hashed, prefix in prefixes]
    twin = ~C.starts(doc, *names)

    # windows of words: a repeated one covers its words, the first of its kind included
    n = max(0, len(start) - WINDOW + 1)
    grams = []
    for number, name in enumerate(names):
        total = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            total += name[k : k + n] * FACTORS[number, k]
        grams.append(mixed(total))
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 : WINDOW - 1 + n]) if n else np.zeros(0, np.int64)
    order, again = equal_before(doc[whole], *[g[whole] for g in grams])
    order, repeated = whole[order], again.copy()
    repeated[:-1] |= again[1:]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, order[repeated], 1)
    np.add.at(cover, order[repeated] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    # lines: those of a text end at line feeds and at its end
    feeds = np.flatnonzero(data == 10)
    line_doc = np.concatenate((np.arange(docs), np.searchsorted(offsets, feeds, side="right") - 1))
    line_start = np.concatenate((offsets[:-1], feeds + 1))
    sort = np.lexsort((line_start, line_doc))
    line_doc, line_start = line_doc[sort], line_start[sort]
    line_stop = np.append(line_start[1:], 0) - 1
    last = np.append(line_doc[1:] != line_doc[:-1], True) if docs else np.zeros(0, bool)
    line_stop[last] = offsets[1:]
    worded = np.searchsorted(start, line_stop) > np.searchsorted(start, line_start)
    line_doc, line_start, line_stop = line_doc[worded], line_start[worded], line_stop[worded]
    order, again = equal_before(line_doc, *[hashed.runs(prefix, line_start, line_stop) for hashed, prefix in prefixes])

    return {
        "n_words": words,
        "word_chars": per_doc(((data & 0xC0) != 0x80) & ~space),
        "n_symbols": per_doc(SYMBOL[data]),
        "n_dup_lines": np.bincount(line_doc[order[again]], minlength=docs),
        "n_repeat_words": np.bincount(doc[covered], minlength=docs),
        "n_lines": np.bincount(line_doc, minlength=docs),
        "n_twin_words": np.bincount(doc[twin], minlength=docs),
        "n_upper": per_doc(UPPER[data]), "n_lower": per_doc(LOWER[data]), "n_digits": per_doc(DIGIT[data]), "n_marks": per_doc(MARK[data]),
    }


def counts_of(batches):
    for batch in batches:
        for piece in slices(batch, "text", SLICE):
            found = counted(*bytes_of(piece.column("text")))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=["id", *COUNTS]
            )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the ``COUNTS`` of each row of ``docs``, and ``base_failed``.

    Words are runs of other characters than the six ASCII white spaces, and empty, white and null texts have none.
    Lines count if they hold a word; one that equals an earlier line counts as repeated, and so do all words of a
    window of five words that the text holds twice. Other columns are not read.
    """
    asked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = asked.mapInArrow(C.frugal(counts_of), "id long, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def shares(of: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest looks at: shares rather than counts, since a long text is no anomaly, on a scale that spreads
    small ones."""
    words, chars, lines = (np.maximum(1, of[c]).astype(np.float64) for c in ("n_words", "word_chars", "n_lines"))
    letters = np.maximum(1, of["n_upper"] + of["n_lower"])
    return np.log1p(20 * np.column_stack([
        of["n_symbols"] / words, of["n_marks"] / words, of["n_upper"] / letters, of["n_digits"] / chars, chars / words,
        of["n_dup_lines"] / lines, of["n_repeat_words"] / words, of["n_twin_words"] / words,
    ]))


@dataclass
class Forest:
    """Trees as rows of arrays: statistic and value of a node's split, its children, and the path length of a leaf."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    depth: int
    expected: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for t in range(len(self.column)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                # a leaf is its own child
                smaller = x[every, self.column[t][node]] < self.value[t][node]
                node = np.where(smaller, self.left[t][node], self.right[t][node])
            total += self.length[t][node]
        return 2.0 ** (-total / (len(self.column) * self.expected))


def expected_length(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, np.float64)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 0) -> Forest:
    """A forest on the rows of ``good``, within the bounds ``low`` and ``high``; each tree sees ``rows`` of them."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(good))
    # empty sides take levels too
    depth = int(np.ceil(np.log2(max(2, rows)))) + 4
    made = []
    for _ in range(trees):
        todo, nodes = [(0, rng.choice(len(good), rows, replace=False), 0)], [None]
        while todo:
            node, own, level = todo.pop()
            lo = hi = low
            if len(own) > 1 and level < depth:
                room = MARGIN * (high - low)
                lo, hi = np.maximum(low, good[own].min(axis=0) - room), np.minimum(high, good[own].max(axis=0) + room)
            varied = np.flatnonzero(hi > lo)
            if not len(varied):
                nodes[node] = (0, 0.0, node, node, level + float(expected_length(len(own))))
                continue
            c = int(rng.choice(varied))
            cut = hi[c] - (hi[c] - lo[c]) * rng.random()  # above the least
            smaller = good[own, c] < cut
            nodes[node] = (c, float(cut), len(nodes), len(nodes) + 1, 0.0)
            todo += [(len(nodes), own[smaller], level + 1), (len(nodes) + 1, own[~smaller], level + 1)]
            nodes += [None, None]
        made.append(nodes)
    size = max(map(len, made))
    columns = zip(*[zip(*(nodes + [(0, 0.0, 0, 0, 0.0)] * (size - len(nodes))), strict=True) for nodes in made], strict=True)
    column, value, left, right, length = (np.array(c) for c in columns)
    return Forest(column, value, left, right, length, depth, float(max(1e-9, expected_length(rows))))


def fit(labelled: DataFrame, rows: int = SAMPLE, trees: int = TREES) -> Forest | None:
    """A forest on about ``rows`` labelled rows that pass the base rule, chosen by a hash of all counts and the id, at
    most twice as many; None where fewer than two of them are good."""
    passed = labelled.where("NOT base_failed")
    scale, h = 1 << 30, F.xxhash64("id", *COUNTS)
    share = min(scale, -(-rows * scale // max(1, passed.count())))
    found = passed.where(F.pmod(h, F.lit(scale)) < share).orderBy(h).limit(2 * rows).select("good", *COUNTS).collect()
    table = np.array(found, np.float64).reshape(-1, len(COUNTS) + 1)
    good = table[:, 0] == 1
    if good.sum() < 2:
        return None
    x = shares({c: table[:, k + 1] for k, c in enumerate(COUNTS)})
    return grow(x[good], x.min(axis=0), x.max(axis=0), trees)


def scored(forest: Forest | None, keep: list[str]):
    def run(batches):
        for batch in batches:
            of = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}
            score = forest.scores(shares(of)) if forest is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score)], names=[*keep, "score"])

    return run


def with_scores(rows: DataFrame, forest: Forest | None) -> DataFrame:
    keep = rows.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(scored(forest, keep), kinds + ", score double")


def border(labelled: DataFrame, forest: Forest | None, false_share: float = FALSE_SHARE) -> float:
    """Least score that at most ``false_share`` of the rows labelled good reach, of those that pass the base rule; above
    all scores without a forest. Scores are counted in steps, all rows, on the executors."""
    if forest is None:
        return 2.0
    step = F.floor(F.col("score") * STEPS).cast("int")
    found = with_scores(labelled.where("good AND NOT base_failed"), forest).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(STEPS + 2, np.int64)
    for r in found:
        counts[r["step"]] += r["n"]
    beyond = np.cumsum(counts[::-1])[::-1]  # rows in this step and above
    return int(np.flatnonzero(beyond <= false_share * counts.sum())[0]) / STEPS


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: Column | None = None,
    label_id_col: str = "doc_id", false_share: float = FALSE_SHARE, rows: int = SAMPLE, trees: int = TREES,
) -> DataFrame:
    """``id``, ``COUNTS``, ``base_failed``, ``score`` and ``kept``: one row for each row of ``docs``.

    A row is kept if it passes the base rule and its score lies below the border. ``good`` is a column of ``labels``
    that is true for good rows (``quality = 1`` by default); labels that are null, without an id or of an unknown id say
    nothing, and a repeated label counts each time. Without labels only the base rule decides, and scores are 0. Equal
    texts have equal scores; ids play no part in them. A null id stays and has no label. An empty table gives no rows.
    """
    good = F.col("quality") == 1 if good is None else good
    counts = stored(statistics(docs, id_col, text_col))
    known = labels.select(F.col(label_id_col).cast("long").alias("id"), good.alias("good")).where("id IS NOT NULL AND good IS NOT NULL")
    labelled = stored(counts.join(known, "id"))
    forest = fit(labelled, rows, trees)
    least = border(labelled, forest, false_share)
    return with_scores(counts, forest).withColumn("kept", ~F.col("base_failed") & (F.col("score") < least))


def op12_isolation_rules(spark, sf_dir: str) -> DataFrame:
    """Every document by the base rule and the forest."""
    judged = judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), *COUNTS[:5], "base_failed", "kept", "score")
