"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed for each cell of source, language and topic. Raking scales the cells until the totals of every
source, language and topic are at their target shares; a cell's factor then becomes the probability with which its
documents stay, the same decision for a document in every run. With a budget no probability may exceed one: raking then
looks in each step for the factor that brings a category to its target with its full cells left at one, so that margins
hold after that bound too. A category that has less than its target is kept whole, and the others make up for it;
``margins`` tells for each one what was wanted, what can be and what is expected. The cells are as many as the categories
that the targets name allow, whatever the corpus holds, so raking is a matter of some hundred numbers.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.session import stored

OTHER = "(other)"
# Shares by category, or for a whole axis by temperature: the axis' own shares to a power.
Targets = dict[str, dict[str, float | None]]
TEMPERATURE = 0.8


def rake(cells: np.ndarray, shares: list[np.ndarray], rounds: int = 1000, close: float = 1e-10) -> np.ndarray:
    """Factor for each cell of an array of token sums, after which the sums along each axis are in ``shares``.
    Categories without tokens are left out of the targets, whose rest is scaled up."""
    factor = np.ones_like(cells, float)
    total = cells.sum()
    if not total:
        return factor
    wanted = []
    for axis, share in enumerate(shares):
        held = cells.sum(axis=tuple(a for a in range(cells.ndim) if a != axis)) > 0
        share = np.where(held, share, 0.0)
        wanted.append(share / share.sum() if share.sum() else held / held.sum())
    for _ in range(rounds):
        worst = 0.0
        for axis, share in enumerate(wanted):
            now = (cells * factor).sum(axis=tuple(a for a in range(cells.ndim) if a != axis)) / total
            ratio = np.divide(share, now, out=np.zeros_like(share), where=now > 0)
            worst = max(worst, float(np.abs(now - share).max()))
            factor = factor * ratio.reshape([-1 if a == axis else 1 for a in range(cells.ndim)])
        if worst < close:
            break
    return factor


def reachable(held: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """Tokens wanted of each category: its share of the budget, or all that it holds, whose rest goes to the others in
    proportion to their shares."""
    share = np.where(held > 0, share, 0.0)
    if not share.any():
        share = held / max(1.0, held.sum())
    wanted = np.zeros_like(held, dtype=float)
    full = np.zeros(len(held), bool)
    for _ in range(len(held) + 1):
        rest = ~full & (share > 0)
        wanted[full] = held[full]
        if rest.any():
            wanted[rest] = share[rest] / share[rest].sum() * max(0.0, budget - held[full].sum())
        over = rest & (wanted > held)
        if not over.any():
            break
        full |= over
    return np.minimum(wanted, held)


def lifted(cells: np.ndarray, factor: np.ndarray, wanted: float) -> float:
    """The number by which ``factor`` is to be multiplied for ``cells * min(1, factor)`` to add up to ``wanted``."""
    some = (cells > 0) & (factor > 0)
    c, f = cells[some], factor[some]
    if not len(c):
        return 1.0
    if wanted >= c.sum() * (1 - 1e-15):
        return 1 / f.min()
    order = np.argsort(-f)
    c, f = c[order], f[order]
    # with the first m cells at one, the others have to give the rest
    full = np.concatenate(([0.0], np.cumsum(c)[:-1]))
    rest = np.cumsum((c * f)[::-1])[::-1]
    number = np.maximum(0, wanted - full) / rest
    return float(number[np.flatnonzero(number * f <= 1 + 1e-15)[0]])


def capped_rake(cells: np.ndarray, shares: list[np.ndarray], budget: float, rounds: int = 2000, close: float = 1e-9) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probability of each cell for an expected ``budget`` of tokens, and the tokens wanted of each category.

    After it the expected tokens along each axis are those wanted, as far as cells in common allow; a budget that some axis
    cannot give, since its other categories have no share, shrinks to what it can.
    """
    others = [tuple(a for a in range(cells.ndim) if a != axis) for axis in range(cells.ndim)]
    held = [cells.sum(axis=o) for o in others]
    budget = min([budget, *[reachable(h, s, budget).sum() for h, s in zip(held, shares, strict=True)]])
    wanted = [reachable(h, s, budget) for h, s in zip(held, shares, strict=True)]
    factor = np.where(cells > 0, 1.0, 0.0)
    for _ in range(rounds if budget > 0 else 0):
        worst = 0.0
        for axis, goal in enumerate(wanted):
            now = (cells * np.minimum(1, factor)).sum(axis=others[axis])
            worst = max(worst, float((np.abs(now - goal) / np.maximum(goal, 1e-6 * budget)).max()))
            for k, tokens in enumerate(goal):
                at = tuple(k if a == axis else slice(None) for a in range(cells.ndim))
                factor[at] = factor[at] * lifted(cells[at].ravel(), factor[at].ravel(), tokens) if tokens > 0 else 0.0
            factor = np.minimum(factor, 1e12)
        if worst < close:
            break
    return np.minimum(1, factor) if budget > 0 else np.zeros_like(factor), wanted


def words(text: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


# What marks a topic, the first that a text holds: fixed words and signs.
TOPICS = {
    "legal": ("License", "rights reserved", "Copyright"), "contact": ("@", "555-"), "secret": ("token =", "key =", "password"),
    "table": (" | ",), "marked": ("###", "&&&", "$$$", "***", "%%%"),
}
PROSE = "prose"


def topic(text: Column) -> Column:
    """A stand-in for a topic model: the kind of a text by the words and signs in it."""
    body, out = F.coalesce(text.cast("string"), F.lit("")), F.lit(PROSE)
    for name, signs in reversed(TOPICS.items()):
        held = F.lit(False)
        for sign in signs:
            held = held | body.contains(sign)
        out = F.when(held, name).otherwise(out)
    return out


def raked(features: DataFrame, targets: Targets, budget: float | None, part: float | None) -> tuple[DataFrame, DataFrame]:
    """The probability of each cell, and the margins."""
    spark, axes = features.sparkSession, list(targets)
    names = [[*targets[a], *([] if OTHER in targets[a] else [OTHER])] for a in axes]
    sums = features.groupBy(*axes).agg(F.sum("n_tokens").alias("n")).collect()  # at most the product of the targets' sizes
    cells = np.zeros([len(n) for n in names])
    place = [{name: i for i, name in enumerate(n)} for n in names]
    for row in sums:
        cells[tuple(place[k][row[a]] for k, a in enumerate(axes))] = row["n"]
    shares, held = [], []
    for k, (a, listed) in enumerate(zip(axes, names, strict=True)):
        own = cells.sum(axis=tuple(x for x in range(cells.ndim) if x != k))
        held.append(own)
        if all(share is None for share in targets[a].values()):
            shares.append(np.where(own > 0, own / max(1.0, own.sum()), 0) ** TEMPERATURE)
        else:
            shares.append(np.array([targets[a].get(name) or 0.0 for name in listed]))
    budget = budget if part is None else part * cells.sum()
    if budget is None:
        factor = np.where(cells > 0, rake(cells, shares), 0.0)
        p = factor / factor.max() if factor.any() else factor
        total = (cells * p).sum()
        wanted = [np.where(h > 0, s, 0) / max(1e-300, np.where(h > 0, s, 0).sum()) * total for h, s in zip(held, shares, strict=True)]
    else:
        p, wanted = capped_rake(cells, shares, budget)
    rows = [(*combo, float(p[tuple(place[k][c] for k, c in enumerate(combo))])) for combo in itertools.product(*names)]
    table = spark.createDataFrame(rows, ", ".join(f"{a} string" for a in axes) + ", probability double")
    found = []
    for k, (a, listed) in enumerate(zip(axes, names, strict=True)):
        expected = (cells * p).sum(axis=tuple(x for x in range(cells.ndim) if x != k))
        share = shares[k] / max(1e-300, shares[k].sum())
        found += [(a, n, *map(float, row)) for n, *row in zip(listed, share, held[k], wanted[k], expected, strict=True)]
    return table, spark.createDataFrame(found, "axis string, category string, share double, held double, wanted double, expected double")


def features_of(docs: DataFrame, targets: Targets, id_col: str, text_col: str, columns: dict[str, Column]) -> DataFrame:
    """``id, n_tokens`` and the category of each axis; what the targets don't name is ``(other)``, null included."""
    text = F.col(text_col)
    counted = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), text.cast("string"), F.lit("")), F.lit("mix")).alias("h"),
        words(text).alias("n_tokens"), *[c.cast("string").alias(a) for a, c in columns.items()], text.alias("text"),
    )
    if "topic" in targets and "topic" not in columns:
        counted = counted.withColumn("topic", topic(F.col("text")))
    for axis, share in targets.items():
        counted = counted.withColumn(axis, F.when(F.col(axis).isin(*share), F.col(axis)).otherwise(OTHER))
    return counted.drop("text")


def sampled(features: DataFrame, targets: Targets, budget: float | None, part: float | None, seed: int) -> DataFrame:
    table = F.broadcast(raked(features, targets, budget, part)[0])  # as many rows as cells
    chance = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    found = features.join(table, list(targets), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return found.withColumn("kept", chance < F.col("probability"))


def mix(
    docs: DataFrame, targets: Targets, columns: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
    budget: float | None = None, seed: int = 0, part: float | None = None,
) -> DataFrame:
    """``doc_id``, the category on each axis, ``n_tokens, probability, kept`` for each row of ``docs``.

    ``targets`` gives the share of tokens for each category of each axis, ``columns`` the column of each axis; an axis
    ``topic`` without a column is taken from words and signs in the text. An axis whose shares are all None takes its own token
    shares to the power ``TEMPERATURE``. Categories that the targets don't name, and null, are ``(other)``, whose share
    is 0 unless it is named or goes by temperature. ``part`` is a budget as a part of the input's tokens: categories that
    have less than their target are kept whole, and the others make up for it, so that all other margins hold. Without ``budget`` and ``part`` as much is kept
    as holds all shares, which one tiny cell can make very little. A document is kept if a hash of its id is below its
    probability; rows with a null id go by their text, and rows that repeat an id are decided alike. Null and empty texts
    have no tokens. An empty table gives no rows.
    """
    features = stored(features_of(docs, targets, id_col, text_col, columns))
    found = sampled(features, targets, budget, part, seed)
    return found.select(F.col("id").alias("doc_id"), *targets, "n_tokens", "probability", "kept")


def margins(
    docs: DataFrame, targets: Targets, columns: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
    budget: float | None = None, part: float | None = None,
) -> DataFrame:
    """``axis, category, share, held, wanted, expected``: for each category of the targets its share, the tokens that it
    holds, those that it is to give (``held`` where that is less than its share asks for), and those that the
    probabilities of ``mix`` are expected to give. Where the last two differ, the cells in common left no way."""
    return raked(stored(features_of(docs, targets, id_col, text_col, columns)), targets, budget, part)[1]


# Languages have given shares; sources and topics come nearer to equal ones. What is not named here counts as ``(other)``.
TARGETS: Targets = {
    "source": dict.fromkeys([*(f"src{i}" for i in range(20)), OTHER]),
    "lang": {"en": 0.50, "fr": 0.18, "de": 0.18, "es": 0.12, OTHER: 0.02},
    "topic": dict.fromkeys([*TOPICS, PROSE]),
}
# Part of the input's tokens that the sample is to hold.
PART = 0.5


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return mix(docs, TARGETS, {"source": F.col("source"), "lang": F.col("lang")}, part=PART)
