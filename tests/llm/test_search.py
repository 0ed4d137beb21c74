import math

import numpy as np
import pytest

from furrow.llm import vp_search as V
from furrow.llm.vp_search import Tree, distances, nearest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, vector string"


def vectors(n, width=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # a hot vector
    return [(i, [float(v) for v in x[i]], 0, "s", "v") for i in range(n)]


def brute(rows, k):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            good[i] = np.array(v)
    out = []
    for q in good:
        if q % 10 == 0:
            found = sorted((float(distances(v, good[q])), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [10_000, 100, 7])
def test_factor_one_is_exact(spark, shard_rows):
    odd = [(1000, None, 0, "", ""), (1001, [0.0] * 8, 0, "", ""), (1010, [float("nan")] * 8, 0, "", ""), (1020, [1.0, None] * 4, 0, "", ""),
           (1030, [float("inf")] * 8, 0, "", ""), (None, [1.0] * 8, 0, "", ""), (1040, [1.0, 2.0], 0, "", ""), (1041, [1.0, 2.5], 0, "", "")]
    rows = vectors(700) + odd + vectors(20)  # the last twenty repeat ids and vectors
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in nearest(df, F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False)), k=5, factor=1.0, shard_rows=shard_rows).collect())
    want = brute(rows, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14, atol=0)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame(vectors(3), SCHEMA)
    assert nearest(df, F.col("vec_id") == 0, k=10).count() == 2
    assert nearest(df.limit(0), F.col("vec_id") == 0, k=10).count() == 0


def test_recall_of_the_registered_factor():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    found, _ = Tree(ids, x).search(x[:80], ids[:80], 10, 3.0)
    hits = 0
    for q in range(80):
        d = distances(x, x[q])
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & set(found[q]))
    assert hits / 800 >= 0.9


@pytest.mark.parametrize("norm", [1.0, 1e3, 1e4, 1e5, 1e6])
def test_close_vectors_far_from_the_origin(norm):
    """The pre-filter by products loses none of them, whatever their norm is."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=64) * norm / 8 + rng.normal(size=(1000, 64)) * 1e-3
    ids = np.arange(len(x))
    found, _ = Tree(ids, x).search(x[:50], ids[:50], 10, 1.0)
    for q in range(50):
        d = distances(x, x[q])
        d[q] = np.inf
        assert found[q].tolist() == np.lexsort((ids, d))[:10].tolist()


def clustered(n, clusters=40, width=16, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, width))[rng.integers(0, clusters, n)] * 20 + rng.normal(size=(n, width))


def test_queries_visit_few_shards_of_clustered_vectors(spark):
    """Below half of all shards at factor one, without losing a neighbour."""
    x = clustered(3000)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 30 == 0, k=5, shard_rows=50).collect()
    want = []
    for q in range(0, 3000, 30):
        d = distances(x, x[q])
        d[q] = np.inf
        want += [(q, r + 1, int(i)) for r, i in enumerate(np.lexsort((np.arange(3000), d))[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want
    # the visits that the bounds of the own shard leave
    pivots = x[:60]
    d = V.pivot_distances(x, pivots)
    own = d.argmin(axis=1)
    radius = np.array([d[own == p, p].max() for p in range(60)])
    queries = np.arange(0, 3000, 30)
    bound = np.array([np.sort(distances(x[own == own[q]], x[q]))[1:6][-1] if (own == own[q]).sum() > 5 else np.inf for q in queries])
    assert V.room(x[queries], own[queries], bound, pivots, radius, 1.0).mean() < 0.5


def test_no_shard_with_a_neighbour_is_left_out():
    """At factor one every vector within the bound lies in a shard that is visited."""
    for seed in range(3):
        x = np.concatenate((clustered(400, seed=seed), np.random.default_rng(seed).normal(size=(200, 16))))
        pivots = x[::40]
        d = V.pivot_distances(x, pivots)
        own = d.argmin(axis=1)
        radius = np.array([d[own == p, p].max(initial=0) for p in range(len(pivots))])
        for bound in (0.5, 5.0, 20.0):
            visit = V.room(x, own, np.full(len(x), bound), pivots, radius, 1.0)
            for q in range(0, len(x), 17):
                assert visit[q, own[distances(x, x[q]) <= bound]].all()


def test_registered(spark):
    """Every hundredth vector against brute force on whole tables."""
    from furrow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = QUERIES["op8_vp_search"](spark, sf).collect()
    hits = 0
    for q in ids[ids % 100 == 0].tolist():
        d = distances(x, x[ids == q][0])
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(r.score == d[ids == r.vec_id][0] for r in own)
        hits += len(set(best) & {r.vec_id for r in own})
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()
