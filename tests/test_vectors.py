"""Neighbours, clusters, homographies and the registration job."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.functions.geometry import project, squared_residual
from furrow.operators import bands as B
from furrow.operators import homography as G
from furrow.operators import png
from furrow.operators import vectors as V
from furrow.plans import jobs
from furrow.sources import files


def described(spark, seed=0, hot=120):
    """A hot group and a small one, with exact duplicates among the targets."""
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in (("hot", hot), ("cold", 9)):
        for band in (1, 2, 3):
            for kp in range(n):
                vector = rng.integers(0, 4, 6).astype(float)
                rows.append((key, band, kp, [float(v) for v in (np.ones(6) if kp % 10 == 0 else vector)]))
    return rows, spark.createDataFrame(rows, "group_key STRING, band INT, kp BIGINT, desc ARRAY<FLOAT>")


@pytest.mark.parametrize("block", [7, 10_000])
def test_nearest_two_is_exact(spark, block):
    rows, df = described(spark)
    got = {(r["group_key"], r["band"], r["kp"], r["rank"]): (r["target_kp"], r["dist"]) for r in V.nearest_two(df, 1, block).collect()}
    seen = 0
    for key, band, kp, vector in rows:
        if band == 1:
            continue
        targets = [(float(np.linalg.norm(np.array(vector) - np.array(t[3]))), t[2]) for t in rows if t[0] == key and t[1] == 1]
        for rank, (dist, target) in enumerate(sorted(targets)[:2], 1):
            assert got[key, band, kp, rank] == (target, pytest.approx(dist))
            seen += 1
    assert seen == len(got)


def test_descriptors_are_dealt_out_once(spark):
    """Both sides meet by one exchange each; a third one puts the candidates of a keypoint together."""
    _, df = described(spark)
    plan = V.nearest_two(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_matches_in_turns_are_all_matches(spark):
    rows, df = described(spark, 40)
    more = df.unionByName(df.withColumn("group_key", F.concat("group_key", F.lit("2")))).withColumn("desc", F.transform("desc", lambda v, i: v + i * F.col("kp") / 100))
    whole = collections.Counter(map(tuple, V.ratio_matches(V.nearest_two(more, 1), 0.9).collect()))
    assert len(whole) > 20
    for turn_bytes in (1 << 30, 2000):
        assert collections.Counter(map(tuple, V.matches_in_turns(more, 1, 0.9, turn_bytes).collect())) == whole
    assert not V.matches_in_turns(more.limit(0), 1).collect()


def test_single_target_has_one_neighbour(spark):
    df = spark.createDataFrame(
        [("g", 1, 0, [0.0, 0.0]), ("g", 2, 0, [3.0, 4.0]), ("g", 2, 1, None)], "group_key STRING, band INT, kp BIGINT, desc ARRAY<FLOAT>"
    )
    near = V.nearest_two(df, 1)
    assert [(r["kp"], r["target_kp"], r["dist"]) for r in near.collect()] == [(0, 0, 5.0)]
    assert V.ratio_matches(near).count() == 0


def test_line_clusters(spark):
    values = [0, 1, 2, 50, 51, 100, 101, 102, 200]
    df = spark.createDataFrame([(v,) for v in values], "n BIGINT")
    assert V.fit_line(df, "n", 4) == pytest.approx([1.0, 50.5, 101.0, 200.0])
    assert V.fit_line(df.limit(0), "n", 4) == []
    assert V.fit_line(spark.createDataFrame([(7,)], "n BIGINT"), "n", 3) == [7.0, 7.0, 7.0]


def test_fitted_words_and_check_points(spark, tmp_path):
    rng = np.random.default_rng(0)
    points = [(i, (np.array(c) + rng.normal(0, 0.2, 3)).tolist()) for c in ((0.2,) * 3, (9.2,) * 3, (18.5,) * 3) for i in range(30)]
    df = spark.createDataFrame(points, "image_id BIGINT, desc ARRAY<DOUBLE>")
    model = V.fit_words(df, iterations=20, seed=3)
    from furrow.sources import sinks

    sinks.save_model(model, str(tmp_path / "model"))
    centers = V.model_centers(df, sinks.load_model(str(tmp_path / "model")))
    cost = [V.cluster_cost(df, V.model_centers(df, V.fit_words(df, k=k, iterations=10, seed=3))).first()["cost"] for k in (2, 6)]
    assert cost[1] < cost[0]
    # three hand-picked points fall in different classes when the start found all groups
    checks = spark.createDataFrame([([0.2, 0.5, 0.9],), ([9.0, 9.6, 9.1],), ([18.7, 18.6, 18.1],)], "desc ARRAY<DOUBLE>")
    classes = [r["cluster"] for r in V.nearest_center(checks, centers).collect()]
    assert classes == sorted(classes)


def test_a_list_of_too_many_centers_is_refused(spark):
    centers = spark.range(5).select(F.col("id").cast("int").alias("cluster"), F.array(F.col("id").cast("double")).alias("center"))
    with pytest.raises(ValueError, match="more than 4 centers"):
        V.center_list(centers, limit=4)
    assert V.center_list(centers).ravel().tolist() == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_nearest_center_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 0.0],)], "desc ARRAY<FLOAT>")
    centers = spark.createDataFrame([(1, [2.0, 0.0]), (0, [-2.0, 0.0])], "cluster INT, center ARRAY<DOUBLE>")
    assert [(r["cluster"], r["dist"]) for r in V.nearest_center(df, centers).collect()] == [(0, 2.0), (1, 1.0)]


def test_identity_has_no_residual(spark):
    df = spark.createDataFrame([(1.5, 2.5)], "x DOUBLE, y DOUBLE")
    h = F.array(*[F.lit(v) for v in (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0)])
    x, y = F.col("x"), F.col("y")
    assert df.select(squared_residual(h, x, y, x, y), *project(h, x, y)).first() == (0.0, 1.5, 2.5)


TRUE = np.array([1.02, -0.05, 12.0, 0.04, 0.98, -7.0, 1e-5, 2e-5, 1.0])


def matched(spark, n=300, outliers=0.3, group="g", band=2, seed=0):
    rng = np.random.default_rng(seed)
    s = rng.uniform(0, 1000, (n, 2))
    w = TRUE[6] * s[:, 0] + TRUE[7] * s[:, 1] + 1
    d = np.stack([(TRUE[0] * s[:, 0] + TRUE[1] * s[:, 1] + TRUE[2]) / w, (TRUE[3] * s[:, 0] + TRUE[4] * s[:, 1] + TRUE[5]) / w], 1)
    bad = rng.random(n) < outliers
    d[bad] = rng.uniform(0, 1000, (bad.sum(), 2))
    return [(group, band, i, *map(float, (*s[i], *d[i]))) for i in range(n)], int((~bad).sum())


MATCHES = "group_key STRING, band INT, kp BIGINT, xs DOUBLE, ys DOUBLE, xd DOUBLE, yd DOUBLE"


def test_known_transform_is_recovered(spark):
    rows, good = matched(spark)
    few = [("few", 2, i, float(i), 1.0, float(i), 1.0) for i in range(4)]
    got = {r["group_key"]: r for r in G.fit_homographies(spark.createDataFrame(rows + few, MATCHES).repartition(3)).collect()}
    assert got["few"]["h"] is None
    assert np.allclose(got["g"]["h"], TRUE, rtol=1e-3, atol=1e-3)
    assert got["g"]["inliers"] >= good and got["g"]["bp_error"] < 30


@pytest.mark.parametrize("share", [0.5, 0.3, 0.2])
def test_known_transforms_are_recovered_among_outliers(spark, share):
    rows = [r for k in range(8) for r in matched(spark, n=400, outliers=1 - share, group=f"g{k}", seed=k)[0]]
    got = {r["group_key"]: r for r in G.fit_homographies(spark.createDataFrame(rows, MATCHES).repartition(3)).collect()}
    assert len(got) == 8 and all(np.allclose(r["h"], TRUE, rtol=1e-2, atol=1e-2) for r in got.values())


def test_no_transform_is_no_transform(spark):
    """Matches that agree on nothing have none, instead of an arbitrary one."""
    rows = matched(spark, n=300, outliers=1.0)[0]
    got = G.fit_homographies(spark.createDataFrame(rows, MATCHES), least_share=0.3).first()
    assert got["h"] is None


def test_noise_ends_early_and_all_matches_vote(spark):
    """Quadruples follow the best vote so far; few candidates of a group meet its matches, whatever it holds."""
    rows = [r for k, share in enumerate((0.0, 0.2, 0.5, 0.9)) for r in matched(spark, n=3000, outliers=1 - share, group=f"g{k}", seed=k)[0]]
    usable = G._blocks(spark.createDataFrame(rows, MATCHES))
    found = G.candidates(usable, G.REPROJECTION, 0.15, G.CONFIDENCE, 1)
    drawn = {r["group_key"]: r["drawn"] for r in found.collect()}
    assert drawn["g3"] <= drawn["g2"] == G.DRAWN <= drawn["g1"] <= 2 * G.draws(0.2) and drawn["g0"] <= 4 * drawn["g1"]
    assert found.agg(F.max(F.size("tries"))).first()[0] <= 9 * G.FINAL
    votes = {r["group_key"]: r for r in G.best_votes(usable, found, G.REPROJECTION).collect()}
    assert {r["n_matches"] for r in votes.values()} == {3000} and votes["g3"]["hits"] > 2600 and votes["g1"]["hits"] > 550


def test_python_gets_matches_by_number(spark):
    """A batch for Python holds a bounded number of matches, however many blocks and groups there are, and their votes are whole."""
    rows = [r for k in range(60) for r in matched(spark, n=500, group=f"g{k}", seed=k)[0]]
    usable = G._blocks(spark.createDataFrame(rows, MATCHES).coalesce(1)).coalesce(1)
    tries = [*TRUE, *np.eye(3).ravel()]
    found = usable.select("group_key", "band").distinct().withColumn("tries", F.array(*[F.lit(float(v)) for v in tries])).withColumn("norm", F.lit(None))
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        opened = G._opened(usable.join(found, G.KEYS), "tries")
        sizes = opened.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), "n BIGINT, bytes BIGINT")
        n, largest = sizes.agg(F.sum("n"), F.max("bytes")).first()
        votes = {r["group_key"]: r for r in G.best_votes(usable, found, G.REPROJECTION).collect()}
        plan = G.best_votes(usable, found, G.REPROJECTION)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert n == 30_000 and largest < 700 * 8 * (len(tries) + 20)
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    for k in range(60):
        p = np.array([r[3:] for r in rows if r[0] == f"g{k}"])
        hits = (G._residuals(np.array(tries), p) <= G.REPROJECTION**2).sum(axis=1)
        assert votes[f"g{k}"]["hits"] == hits.max() and votes[f"g{k}"]["n_matches"] == 500


def test_all_members_stay(spark):
    rows = [("a", b % 7 + 1, f"n{b:05d}", float(b)) for b in range(5000)] + [("b", 1, "n", 1.0), ("b", 1, "n", 1.0)]
    df = spark.createDataFrame(rows, "group_key STRING, band INT, name STRING, v DOUBLE")
    got = sorted(map(tuple, B.group_members(df).collect()))
    assert got[:5000] == [("a", k, f"n{k:05d}", k % 7 + 1, float(k), 5000) for k in range(5000)]
    assert got[5000:] == [("b", 0, "n", 1, 1.0, 2), ("b", 1, "n", 1, 1.0, 2)]
    wide = B.align_bands(df.withColumns({"y": F.lit(0), "x": F.lit(0)})).orderBy("group_key").collect()
    assert [r["set_aside"] for r in wide] == [4995, 1] and wide[1]["b2"] is None


def test_registration_job(spark, tmp_path):
    """Five shifted 16-bit bands with descriptors that identify the same corners."""
    rng = np.random.default_rng(1)
    scene = rng.integers(0, 65535, (60, 80)).astype(np.uint16)
    shifts = {1: (0, 0), 2: (2, 1), 3: (-1, 2), 4: (1, 0), 5: (0, -2)}
    keypoints, vectors = [], rng.random((40, 16))
    for band, (dx, dy) in shifts.items():
        (tmp_path / f"IMG_0000_{band}.png").write_bytes(png.encode(np.roll(scene, (dy, dx), (0, 1))))
        for i, v in enumerate(vectors):
            x, y = float(10 + i % 8 * 7), float(10 + i // 8 * 8)
            keypoints.append(("0000", band, i, (v + rng.normal(0, 1e-3, 16)).tolist(), x + dx, y + dy))
    (tmp_path / "IMG_0000_9.png").write_bytes(b"broken")
    assert files.bands(spark, str(tmp_path)).count() == 5
    named = files.band_files(files.scan(spark, str(tmp_path)))
    points = spark.createDataFrame(keypoints, "group_key STRING, band INT, kp BIGINT, desc ARRAY<FLOAT>, x DOUBLE, y DOUBLE")
    products = {r["name"]: png.decode(bytes(r["content"])) for r in jobs.register(named, points, 80, 60).collect()}
    assert set(products) == {*(f"IMG_0000_{b}" for b in range(1, 6)), "IMG_0000_RGB", "IMG_0000_RGB_CROPPED", "IMG_0000_NDVI"}
    first = products["IMG_0000_1"].astype(int)
    for band in range(2, 6):
        inner = products[f"IMG_0000_{band}"].astype(int)[10:-10, 10:-10]
        assert (abs(inner - first[10:-10, 10:-10]) <= 40).mean() > 0.95
    assert products["IMG_0000_RGB_CROPPED"].shape[0] < 60
