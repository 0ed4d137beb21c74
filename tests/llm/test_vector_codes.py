import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, part string, id string"


def plainly(rows, parts, entries, rounds):
    """Codes, errors and codebooks by Python's own integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    own = lambda v, p: v[p * size : (p + 1) * size]
    books = [[own(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[near(own(v, p), books[p])[1]].append(own(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else c for e, c in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [near(own(v, p), books[p]) for p in range(parts)]
        out.append((i, label, [e for _, e in found], sum(d for d, _ in found)))
    return sorted(out, key=str), books


def vectors(n, width=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[1]  # a hot vector
    return [(i, [float(v) for v in x[i]], None if i % 7 == 0 else i % 3, "p", "i") for i in range(n)]


@pytest.mark.parametrize("block,entries", [(256, 16), (8, 16), (8, 400)])
def test_odd_rows(spark, monkeypatch, block, entries):
    monkeypatch.setattr(V, "BLOCK", block)
    odd = [(900, None, 1, "", ""), (901, [float("nan")] * 8, 1, "", ""), (902, [1.0, None] * 4, 1, "", ""), (903, [float("-inf")] * 8, 2, "", ""),
           (None, [0.25] * 8, 5, "", ""), (904, [0.0] * 8, 1, "", ""), (3, [-0.5] * 8, 1, "", ""), (905, [-3000.0, 3000.0] * 4, 2, "", "")]
    rows = vectors(300) + odd + vectors(9)  # the last ones repeat rows
    coded, books = V.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries)
    want, want_books = plainly(rows, 4, entries, 4)
    assert [b.tolist() for b in books] == want_books
    assert sorted([tuple(r) for r in coded.collect()], key=str) == want


def test_lengths(spark):
    """Rows of another length come back without codes; without a length that can be cut, or ids, all do."""
    rows = vectors(20)
    coded, _ = V.encode(spark.createDataFrame(rows + [(50, [1.0] * 4, 1, "", ""), (51, [1.0] * 5, None, "", ""), (52, [], 1, "", ""), (53, [1e30] * 8, 1, "", "")], SCHEMA))
    got = {r.id: r for r in coded.collect()}
    assert set(got) == {*range(20), 50, 51, 52} and {i for i, r in got.items() if r.codes is None} == {50, 51, 52}
    coded, books = V.encode(spark.createDataFrame([(1, [1.0] * 3, 1, "", "")], SCHEMA))
    assert coded.collect()[0].codes is None and V.digest(books) == V.digest([])
    coded, _ = V.encode(spark.createDataFrame([(None, [1.0] * 8, 1, "", "")] * 2, SCHEMA))
    assert [tuple(r) for r in coded.collect()] == [(None, 1, None, None)] * 2
    assert V.encode(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_curve():
    """Every cell has a place of its own, and neighbours on the curve are neighbours in space."""
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        place = V.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        along = cells[np.argsort(place)].astype(int)
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


NUMBER = st.one_of(st.integers(-9, 9), st.integers(-(2**27), 2**27))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda w: st.tuples(*[st.lists(st.lists(NUMBER, min_size=w, max_size=w), min_size=1, max_size=12)] * 2)))
def test_shortlists_lose_no_entry(both):
    """The nearest entry of every vector of a block is on its shortlist, ties included."""
    x, entries = (np.array(a, np.int64) for a in both)
    block = next(V.blocked(x.shape[1], V.pa.int32())([V.pa.RecordBatch.from_pydict({
        "part": V.pa.array([0] * len(x), V.pa.int32()), "id": np.arange(len(x)), "name": np.arange(len(x)),
        "label": V.pa.array([None] * len(x), V.pa.int32()), "components": [r.astype("<i4").tobytes() for r in x]})]))
    boxes = V.Boxes(block, x.shape[1])
    few = boxes.shortlist(0, entries)
    exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(entries)) for v in x]
    best, error = V.nearest(boxes.vectors(0), entries[few])
    assert [(int(d), int(few[b])) for b, d in zip(best, error, strict=True)] == exact
    assert boxes.sums[0].tolist() == x.sum(axis=0).tolist()


def test_registered(spark):
    from furrow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, books = plainly([(r.vec_id, r.embedding, r.label) for r in table], 4, 256, 4)
    by_label = collections.Counter()
    for _, label, _, error in want:
        by_label[label] += error
    digest = V.digest([np.array(b) for b in books])
    got = [tuple(r) for r in QUERIES["op11_vector_codes"](spark, sf).collect()]
    assert sorted(got) == sorted((i, "".join(f"{e:02x}" for e in codes), error, by_label[label], digest) for i, label, codes, error in want)
