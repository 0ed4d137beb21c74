"""Hash-seeded k-means and nearest centers in blocks, against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import clustering as K
from furrow.operators import vectors as V
from furrow.sources import sinks


def as_points(spark, x):
    return spark.createDataFrame([(i % 7, i, [float(c) for c in v]) for i, v in enumerate(x)], "image_id BIGINT, kp BIGINT, desc ARRAY<DOUBLE>").repartition(3)


def as_centers(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "cluster INT, center ARRAY<DOUBLE>")


def nearest(x, centers):
    d = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(axis=2))
    return d.argmin(axis=1), d.min(axis=1)


def test_twenty_thousand_centers(spark):
    """More centers than travel: equal to brute force, and no center is broadcast."""
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(20_000, 8))
    centers[9000:9100] = centers[5]  # ties go to the first
    x = np.concatenate((rng.normal(size=(300, 8)), centers[[5, 9050, 19_999]], rng.normal(size=(20, 8)) * 50))
    got = V.nearest_center(as_points(spark, x), as_centers(spark, centers))
    rows = sorted(got.collect(), key=lambda r: r["kp"])
    want = nearest(x, centers)
    assert [r["cluster"] for r in rows] == want[0].tolist() and np.allclose([r["dist"] for r in rows], want[1], rtol=1e-12)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    # what Spark broadcasts on its own, for its small size, are points
    assert not any("_center" in part[:900] for part in plan.split("BroadcastExchange")[1:])


@pytest.mark.parametrize("block,point_block", [(16, 8), (400, 50)])
def test_hot_blocks_are_cut(spark, block, point_block):
    """A third of the centers and of the points lie in one place."""
    rng = np.random.default_rng(1)
    centers, x = rng.integers(-50, 50, (600, 3)).astype(float), rng.integers(-50, 50, (200, 3)).astype(float)
    centers[100:300] = rng.integers(0, 2, (200, 3))
    x[50:120] = [1, 0, 1]
    got = K.nearest_in_blocks(as_points(spark, x), as_centers(spark, centers), block=block, point_block=point_block).collect()
    want = nearest(x, centers)
    assert {r["kp"]: (r["cluster"], round(r["dist"], 9)) for r in got} == {i: (c, round(d, 9)) for i, (c, d) in enumerate(zip(*want, strict=True))}


def test_most_blocks_are_not_visited(spark, monkeypatch):
    """In clustered data a point visits few blocks."""
    rng = np.random.default_rng(2)
    places = rng.normal(size=(40, 16)) * 100
    centers, x = (np.repeat(places, n, axis=0) + rng.normal(size=(40 * n, 16)) for n in (50, 10))
    seen = []
    whole = K.F.explode

    def counted(column):
        seen.append(column)
        return whole(column)

    monkeypatch.setattr(K.F, "explode", counted)
    got = K.nearest_in_blocks(as_points(spark, x), as_centers(spark, centers), block=50).collect()
    monkeypatch.undo()
    assert [r["cluster"] for r in sorted(got, key=lambda r: r["kp"])] == nearest(x, centers)[0].tolist()
    visits = as_points(spark, x).select(F.size(seen[0]).alias("n")).agg(F.avg("n")).first()[0]
    assert visits < 0.5 * 40


def test_gaps_in_numbers_are_refused(spark):
    centers = as_centers(spark, np.eye(3)).where("cluster <> 1")
    for run in (lambda: V.nearest_center(as_points(spark, np.eye(3)), centers), lambda: K.nearest_in_blocks(as_points(spark, np.eye(3)), centers)):
        with pytest.raises(ValueError, match="without gaps"):
            run()


def test_many_words(spark):
    """The long form gives the groups of the wide one, and works for words that the wide form has no columns for."""
    rng = np.random.default_rng(3)
    for clusters, n in ((3, 60), (3, 8), (40, 500), (40, 60)):
        centers, points = as_centers(spark, rng.normal(size=(clusters, 4))), as_points(spark, rng.normal(size=(n, 4)))
        for pooling in ("max", "sum"):
            wide = {r["image_id"]: r["grp"] for r in V.bag_of_words(points, centers, pooling, clusters).collect()}
            long = {r["image_id"]: r["grp"] for r in V.bag_of_many_words(points, centers, clusters, pooling).collect()}
            assert wide == long


def u(key, number):
    return int(hashlib.sha256(f"{number}:{key}".encode()).hexdigest()[:8], 16) / 2**32


def plainly(x, k, steps):
    """Seeding, reduction and Lloyd steps with loops."""
    chosen = [min(range(len(x)), key=lambda i: (hashlib.sha256(f"0:{i}".encode()).hexdigest(), i))]
    for number in range(1, K.SEED_ROUNDS + 1):
        d = ((x[:, None] - x[chosen][None]) ** 2).sum(axis=2).min(axis=1)
        chosen += [i for i in range(len(x)) if u(i, number) * d.sum() < K.OVERSAMPLING * k * d[i]]
    chosen.sort()
    weight = np.bincount(nearest(x, x[chosen])[0], minlength=len(chosen))
    starts = [max(range(len(chosen)), key=lambda c: (weight[c], -c))]
    while len(starts) < min(k, len(chosen)):
        reach = [weight[c] * min(((x[chosen[c]] - x[chosen[s]]) ** 2).sum() for s in starts) for c in range(len(chosen))]
        if not any(reach):
            break
        starts.append(max(range(len(chosen)), key=lambda c: (reach[c], -c)))
    centers = x[[chosen[s] for s in starts]]
    for _ in range(steps):
        own = nearest(x, centers)[0]
        centers = np.array([x[own == c].mean(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
    return sorted(centers.tolist())


@pytest.mark.parametrize("k", [1, 3, 12])
def test_fitted_centers(spark, k):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 5)) + c for c in (0, 9, 20)])
    x[30:90] = x[0]  # a hot point
    points = as_points(spark, x)
    rows = K.fit_centers(points, k, 5).orderBy("cluster").collect()
    want = plainly(x, k, 5)
    assert [r["cluster"] for r in rows] == list(range(len(want))) and np.allclose([r["center"] for r in rows], want)
    again = K.fit_centers(points.repartition(7), k, 5).orderBy("cluster").collect()
    assert np.allclose([r["center"] for r in again], want)


def test_few_points(spark):
    assert K.fit_centers(as_points(spark, np.zeros((0, 3))), 3, 5).count() == 0
    assert K.fit_centers(as_points(spark, np.ones((9, 3))), 3, 5).count() == 1
    rows = as_points(spark, np.eye(2)).union(spark.createDataFrame([(1, 7, None), (1, 8, [])], "image_id BIGINT, kp BIGINT, desc ARRAY<DOUBLE>"))
    assert sorted(r["center"] for r in K.fit_centers(rows, 5, 5).collect()) == [[0.0, 1.0], [1.0, 0.0]]


def test_saved_centers(spark, tmp_path):
    centers = np.random.default_rng(5).normal(size=(6, 4))
    sinks.save_centers(as_centers(spark, centers).repartition(3), str(tmp_path / "model"))
    found = sinks.load_centers(spark, str(tmp_path / "model")).orderBy("cluster").collect()
    assert [r["center"] for r in found] == centers.tolist()
