import collections
import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import isolation as I
from furrow.llm.bytehash import bytes_of
from furrow.llm.queries import QUERIES
from pyspark.sql import functions as F
from small_tables import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(text):
    """The counts of one text, the slow way."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_twin_words": sum(a == b for a, b in zip(words, words[1:])),
        "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)), "n_digits": len(re.findall("[0-9]", text)),
        "n_marks": len(re.findall(r"[!-/:-@\[-`{-~]", text)),
    }


def base(c):
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text("ab \n\té#1A", max_size=60), st.lists(st.sampled_from("ab c\n"), max_size=60).map(" ".join)), max_size=6))
def test_counts_of_any_batch(texts):
    import pyarrow as pa

    found = I.counted(*bytes_of(pa.array(texts, pa.string())))
    assert [{c: int(found[c][k]) for c in I.COUNTS} for k in range(len(texts))] == [plainly(t) for t in texts]


def test_statistics(spark, table_of, odd_rows):
    long = " ".join(f"w{k % 977}" for k in range(200_000)) + "\n" + "a b\n" * 1000
    rows = odd_rows + [(50, long), (51, "a b c d e a b c d e f"), (52, "x\ny\nx\n\n \nx")]
    got = I.statistics(table_of(rows)).collect()
    key = lambda i, c, f: str((i, [c[n] for n in I.COUNTS], f))
    assert sorted(key(r.id, r.asDict(), r.base_failed) for r in got) == sorted(key(i, c := plainly(t), base(c)) for i, t in rows)


def path(forest, tree, x):
    node, steps = 0, 0
    while forest.left[tree][node] != node:
        node = (forest.left if x[forest.column[tree][node]] < forest.value[tree][node] else forest.right)[tree][node]
        steps += 1
    return forest.length[tree][node], steps


def test_forest():
    rng = np.random.default_rng(3)
    good = rng.normal(size=(600, 3))
    good[:, 2] = 0.5  # never varies among good rows
    odd = np.array([[0, 0, 9.0], [8, 0, 0.5], [0, -8, 0.5]])
    every = np.concatenate((good, odd))
    forest = I.grow(good, every.min(axis=0), every.max(axis=0))
    scores = forest.scores(every)
    for k in (0, 1, 600, 601, 602):
        lengths = [path(forest, t, every[k]) for t in range(I.TREES)]
        assert max(s for _, s in lengths) <= forest.depth
        assert math.isclose(scores[k], 2 ** (-np.mean([n for n, _ in lengths]) / forest.expected))
    assert scores[600:].min() > np.quantile(scores[:600], 0.99) and 0 < scores.min() <= scores.max() <= 1
    assert I.expected_length([0, 1, 2]).tolist() == [0, 0, 1]
    # the published value for 256 rows
    assert math.isclose(float(I.expected_length(256)), 10.244, abs_tol=0.01)


def test_border_is_that_of_all_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = I.judge(docs, labels, false_share=0.05)
    rows = {r.id: r for r in judged.collect()}
    good = [rows[r.doc_id] for r in labels.collect() if r.quality == 1 and not rows[r.doc_id].base_failed]
    dropped = sum(not r.kept for r in good)
    assert dropped <= 0.05 * len(good)
    # one step more would drop too many
    least = min(r.score for r in good if not r.kept) if dropped else 1
    below = [r.score for r in good if r.kept]
    assert sum(s >= max(below) - 1 / I.STEPS for s in below) + dropped > 0.05 * len(good) - 1 and max(below) < least
    assert all(r.kept == (not r.base_failed and r.score < least) or r.base_failed or r.score >= max(below) for r in rows.values())


def test_odd_labels_and_clashing_columns(spark, table_of, odd_rows):
    docs = table_of(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, id string")
    for labels in (none, spark.createDataFrame([(None, 1, "x"), (1, None, "x"), (999, 1, "x")], none.schema)):
        got = I.judge(docs, labels).collect()
        assert sorted(str((r.id, r.kept, r.score)) for r in got) == sorted(str((i, not base(plainly(t)), 0.0)) for i, t in odd_rows)
    labels = spark.createDataFrame([(i, 1, "x") for i in (1, 2, 4, 10, 11, 14)] * 30 + [(9, 0, "y")], none.schema)
    got = I.judge(docs, labels, rows=8).collect()
    assert len(got) == len(odd_rows)
    assert {r.score for r in got if r.id == 1} == {r.score for r in got if r.id == 2}  # equal texts
    assert I.judge(docs.limit(0), labels).count() == 0


def test_registered(spark):
    """The digest columns against plain Python; junk goes and good rows stay."""
    docs = {r.doc_id: plainly(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_isolation_rules"](spark, "/root/testdata/sf0.01")
    assert got.columns[:8] == ["doc_id", *I.COUNTS[:5], "base_failed", "kept"]
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == set(docs)
    for i, c in docs.items():
        assert [rows[i][n] for n in I.COUNTS[:5]] == [c[n] for n in I.COUNTS[:5]] and rows[i].base_failed == base(c)
        assert not (rows[i].base_failed and rows[i].kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    asked = {q: [rows[i] for i, x in labels.items() if x == q and not rows[i].base_failed] for q in (0, 1)}
    assert np.mean([r.kept for r in asked[1]]) >= 0.995 and np.mean([r.kept for r in asked[0]]) <= 0.1


def test_junk_not_learned_from(spark):
    """The border found on one half of the labels, judged on the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.id: r for r in I.judge(docs, labels.where("doc_id % 2 = 0")).collect()}
    other = {r.doc_id: r.quality for r in labels.where(F.col("doc_id") % 2 == 1).collect()}
    held = {q: [rows[i].kept for i, x in other.items() if x == q and not rows[i].base_failed] for q in (0, 1)}
    assert np.mean(held[1]) >= 0.99 and np.mean(held[0]) <= 0.05
