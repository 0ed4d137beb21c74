"""Images: codec, histograms, shifts, blobs, warps and the flower jobs on drawn pictures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import colour, stats
from furrow.operators import histograms as H
from furrow.operators import images as I
from furrow.operators import pixels as P
from furrow.operators import png
from furrow.plans import jobs
from furrow.plans.steps import Step, run_steps
from furrow.sources import files

CORNERS = [(2, 2), (94, 2), (2, 70), (94, 70)]


def field(discs, seed=0, height=72, width=96):
    """A green field with yellow discs, RGB."""
    rng = np.random.default_rng(seed)
    image = np.stack([rng.integers(lo, lo + 25, (height, width)) for lo in (60, 110, 50)], axis=2).astype(np.uint8)
    y, x = np.mgrid[0:height, 0:width]
    for r, c, radius in discs:
        image[(y - r) ** 2 + (x - c) ** 2 <= radius**2] = (250, 230, 10)
    return image


@pytest.mark.parametrize("shape,kind", [((5, 7), np.uint8), ((5, 7), np.uint16), ((4, 6, 3), np.uint8)])
def test_png_round_trip(shape, kind):
    image = np.random.default_rng(1).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (png.decode(png.encode(image)) == image).all()
    assert png.decode(png.encode(image)[:40]) is None
    assert png.decode(b"no image") is None


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_row_filters(kind):
    """Rows written with each filter type come back unchanged."""
    import struct
    import zlib

    image = np.random.default_rng(kind).integers(0, 256, (6, 9)).astype(np.uint8)
    rows, above = [], np.zeros(9, int)
    for line in image.astype(int):
        left, corner = np.r_[0, line[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = {1: left, 2: above, 3: (left + above) // 2, 4: paeth}[kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    head = struct.pack(">IIBBBBB", 9, 6, 8, 0, 0, 0, 0)
    packed = png.MAGIC + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", zlib.compress(b"".join(rows))) + png._chunk(b"IEND", b"")
    assert (png.decode(packed) == image).all()


def test_planes_agree_with_columns(spark):
    pixels = [(b, g, r) for b in range(0, 256, 17) for g in range(0, 256, 17) for r in range(0, 256, 17)]
    df = spark.createDataFrame(pixels, "b INT, g INT, r INT")
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    got = df.select("b", "g", "r", colour.grey(b, g, r).alias("grey"), colour.lab_b(b, g, r).alias("lab")).toPandas()
    plane = got[["b", "g", "r"]].to_numpy(np.uint8).reshape(-1, 1, 3)
    assert (I.grey_plane(plane).ravel() == got["grey"]).all()
    assert (abs(I.lab_b_plane(plane).ravel().astype(int) - got["lab"]) <= 1).all()
    # published anchors: white and black are neutral, blue is far below and yellow far above
    assert I.lab_b_plane(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 255, 255]]], np.uint8)).tolist() == [[128, 128, 20, 222]]


def test_mask_plane_agrees_with_column(spark):
    corners = [(3, 4), (25, 1), (1, 18), (29, 17)]
    df = spark.range(30 * 20).select((F.col("id") % 30).cast("int").alias("x"), F.floor(F.col("id") / 30).cast("int").alias("y"))
    got = {(r["y"], r["x"]) for r in P.in_mask(df, corners, 30, 20).collect()}
    assert got == set(zip(*map(list, np.nonzero(I.mask_plane(20, 30, corners))), strict=True)) and got


def test_wide_and_long_histograms_agree(spark):
    image = field([(20, 20, 5)])[..., ::-1]
    wide = spark.createDataFrame([("a", 72, 96, bytearray(image.tobytes()))], "path STRING, height INT, width INT, data BINARY")
    hists = I.image_histograms(wide, CORNERS).first()
    y, x = np.mgrid[0:72, 0:96]
    long = spark.createDataFrame(
        [(1, int(a), int(b), *map(int, image[a, b])) for a, b in zip(y.ravel(), x.ravel(), strict=True)],
        "image_id BIGINT, y INT, x INT, b INT, g INT, r INT",
    )
    masked = P.in_mask(long, CORNERS, 96, 72)
    grey = H.dense(H.histogram(masked.withColumn("v", colour.grey(F.col("b"), F.col("g"), F.col("r"))))).first()["hist"]
    assert grey == list(hists["hist_g"])
    assert sum(grey) == int(I.mask_plane(72, 96, CORNERS).sum()) == sum(hists["hist_b"])


def test_moving_a_histogram_moves_its_lag(spark):
    base = np.random.default_rng(2).integers(0, 50, 256)
    base[:40] = base[-40:] = 0
    rows = [(k, np.roll(base, k).tolist(), base.tolist()) for k in (0, 1, -7, 30)]
    df = spark.createDataFrame(rows, "k INT, h ARRAY<BIGINT>, r ARRAY<BIGINT>")
    for row in df.select("k", H.best_lag("h", "r").alias("lag")).collect():
        assert row["lag"] == 255 + row["k"]


def test_best_lag_matches_numpy(spark):
    rng = np.random.default_rng(5)
    pairs = [(rng.integers(0, 9, 256), rng.integers(0, 9, 256)) for _ in range(12)]
    df = spark.createDataFrame([(i, a.tolist(), v.tolist()) for i, (a, v) in enumerate(pairs)], "i INT, a ARRAY<BIGINT>, v ARRAY<BIGINT>")
    for row in df.select("i", H.best_lag("a", "v").alias("lag")).collect():
        assert row["lag"] == np.correlate(*pairs[row["i"]], "full").argmax()


def test_threshold_rule_equals_the_byte_casts(spark):
    rng = np.random.default_rng(4)
    pairs = [tuple(map(int, rng.integers(0, 511, 2))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "own INT, ref INT")
    shift = F.pmod(F.col("own") + F.col("ref"), F.lit(256))
    for row in df.select("own", "ref", H.threshold(shift).alias("t")).collect():
        own = np.array(row["own"]).astype(np.int8).astype(int)
        ref = np.array(row["ref"]).astype(np.uint8).astype(int)
        assert row["t"] == (155 + own + ref) % 256


def test_highlight_reference_points(spark):
    df = spark.createDataFrame([(149,), (155,), (0,), (255,)], "v INT")
    got = [r[0] for r in df.select(colour.highlight(F.col("v"), F.lit(0))).collect()]
    assert got == [127, 252, 0, 255]
    plane = I.highlight_plane(np.arange(256, dtype=np.uint8), 300)
    column = spark.range(256).select(colour.highlight(F.col("id"), F.lit(300)).alias("v")).toPandas()["v"]
    assert (plane == column).all()


def test_blobs_on_discs():
    plane = np.zeros((100, 140))
    y, x = np.mgrid[0:100, 0:140]
    centres = [(25, 30), (60, 100), (75, 40)]
    for r, c in centres:
        plane[(y - r) ** 2 + (x - c) ** 2 <= 36] = 1
    found = I.find_blobs(plane)
    assert sorted((int(round(r)), int(round(c))) for r, c, _ in found) == sorted(centres)
    assert len(I.find_blobs(np.zeros((40, 40)))) == 0


def test_sharpen_forms_agree(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(100, 140, (9, 11)).astype(np.uint8)
    rows = [(1, int(y), int(x), int(image[y, x])) for y in range(9) for x in range(11)]
    df = spark.createDataFrame(rows, "image_id BIGINT, y INT, x INT, v INT")
    table = {(r["y"], r["x"]): r["v"] for r in P.sharpen(df, 1.5, 0.8, 5.0).collect()}
    soft = I.blur_plane(image.astype(float), 1.5)
    sharp = soft + 5.0 * (soft - I.blur_plane(soft, 0.8))
    assert all(math.isclose(table[y, x], sharp[y, x], rel_tol=1e-9) for y in range(9) for x in range(11))


def test_blur_keeps_the_mass(spark):
    rows = [(1, y, x, 100.0 if (y, x) == (3, 4) else 0.0) for y in range(7) for x in range(9)]
    df = spark.createDataFrame(rows, "image_id BIGINT, y INT, x INT, v DOUBLE")
    got = {(r["y"], r["x"]): r["v"] for r in P.gaussian_blur(df, 1.0).collect()}
    assert math.isclose(sum(got.values()), 100.0) and max(got, key=got.get) == (3, 4)


def test_warp_forms_agree(spark):
    rng = np.random.default_rng(6)
    image = rng.random((10, 12))
    h = [0.98, -0.17, 1.2, 0.17, 0.98, -0.4, 0.001, 0.0005, 1.0]
    rows = [(1, y, x, float(image[y, x])) for y in range(10) for x in range(12)]
    df = spark.createDataFrame(rows, "image_id BIGINT, y INT, x INT, v DOUBLE")
    homographies = spark.createDataFrame([(1, h)], "image_id BIGINT, h ARRAY<DOUBLE>")
    got = {(r["y"], r["x"]): r["v"] for r in P.warp(df, homographies, 12, 10).collect()}
    plane = I.warp_plane(image, np.array(h))
    assert all(math.isclose(got[y, x], plane[y, x], abs_tol=1e-7) for y in range(10) for x in range(12))


def test_identity_warp_keeps_the_image():
    image = np.random.default_rng(8).random((6, 7))
    assert np.allclose(I.warp_plane(image, np.eye(3).ravel()), image)


def test_region_cells():
    corners = [(0, 0), (30, 0), (0, 30), (30, 30)]
    assert P.region_cells([[0, 0, 0], [0, 1, 0], [0, 0, 0]], corners) == [[(10, 10), (20, 10), (10, 20), (20, 20)]]
    assert len(P.region_cells([[1] * 3] * 3, corners)) == 9


def test_erf_polynomial(spark):
    df = spark.range(-40, 41).select((F.col("id") / 10).alias("x"))
    assert all(abs(r["e"] - math.erf(r["x"])) < 2e-7 for r in df.withColumn("e", stats.erf(F.col("x"))).collect())


def test_steps_check_their_input(spark):
    double = Step("double", ("v",), lambda d: d.withColumn("v", F.col("v") * 2))
    df = spark.createDataFrame([(3,)], "v INT")
    assert run_steps(df, [double, double]).first()["v"] == 12
    with pytest.raises(ValueError, match="double needs columns"):
        run_steps(df.drop("v").withColumn("w", F.lit(1)), [double])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three camera days of drawn fields, one broken, one empty and one damaged picture."""
    root = tmp_path_factory.mktemp("fields")
    for day in ("1108-0701", "1108-0702", "1109-0701"):
        (root / day).mkdir()
        for i in range(4):
            discs = [(15 + 14 * k, 12 + 20 * ((k + i) % 4), 5) for k in range(i)]
            (root / day / f"img{i}.png").write_bytes(png.encode(field(discs, seed=i)))
        (root / day / "broken.png").write_bytes(b"\x89PNG nothing")
        (root / day / "empty.png").write_bytes(b"")
        (root / day / "flat.png").write_bytes(png.encode(np.full((72, 96, 3), 127, np.uint8)))
    return root


def test_decoded_skips_bad_files(spark, folder):
    images = files.decoded(spark, str(folder), recursive=True)
    rows = images.collect()
    assert len(rows) == 15 and {r["height"] for r in rows} == {72}
    first = next(r for r in rows if r["path"].endswith("1108-0701/img2.png"))
    assert (I.bgr(bytes(first["data"]), 72, 96)[..., ::-1] == field([(15, 52, 5), (29, 72, 5)], seed=2)).all()


def test_flower_count_many_datasets(spark, folder):
    images = files.datasets(files.decoded(spark, str(folder), recursive=True), "1108-0", ["1108-0702"])
    got = {r["path"].rsplit("/", 1)[-1]: r["flowers"] for r in jobs.flower_count_many(images, CORNERS).collect()}
    assert set(got) == {"img0.png", "img1.png", "img2.png", "img3.png"}  # the flat picture is damaged


def test_per_dataset_equals_separate_runs(spark, folder):
    images = files.decoded(spark, str(folder), recursive=True)
    hists = I.image_histograms(images, CORNERS).withColumn("dataset", F.element_at(F.split("path", "/"), -2)).cache()
    together = {r["path"]: r["n_yellow"] for r in jobs.flower_pixels_by(hists, "dataset", "path").collect()}
    apart = {}
    for day in ("1108-0701", "1108-0702", "1109-0701"):
        for r in jobs.flower_pixels(hists.where(F.col("dataset") == day), "path").collect():
            apart[r["path"]] = r["n_yellow"]
    assert together == apart and len(apart) == 12


def test_flower_count_job(spark, folder):
    images = files.decoded(spark, str(folder / "1108-0701"))
    result = jobs.flower_count(images, CORNERS)
    rows = result.collect()
    assert result.columns == ["path", "flowers"] and rows
    everything = {r["path"]: r["flowers"] for r in jobs.flower_count(images, CORNERS, select=False).collect()}
    assert all(everything[r["path"]] == r["flowers"] for r in rows) and len(everything) == 4


def test_flower_count_never_shuffles_images(spark, folder):
    result = jobs.flower_count(files.decoded(spark, str(folder / "1108-0701")), CORNERS)
    assert "Exchange" not in result._jdf.queryExecution().executedPlan().toString()


def test_blob_count_on_a_drawn_field(spark):
    discs = [(15, 15, 5), (35, 60, 5), (55, 30, 5)]
    image = field(discs)[..., ::-1]
    df = spark.createDataFrame(
        [("a", 72, 96, bytearray(image.tobytes()), 30, 10), ("b", 72, 96, bytearray(image.tobytes()), 30, 0)],
        "path STRING, height INT, width INT, data BINARY, shift INT, n_yellow BIGINT",
    )
    got = {r["path"]: r for r in I.blobs(df, CORNERS).collect()}
    assert got["a"]["n_blobs"] == 3 and got["b"]["n_blobs"] == 0 and got["b"]["blobs"] == []
    assert sorted((b["x"], b["y"]) for b in got["a"]["blobs"]) == sorted((r, c) for r, c, _ in discs)


def test_conversion_and_sharpening_write_readable_files(spark, folder, tmp_path):
    images = files.decoded(spark, str(folder / "1108-0701"))
    out = str(tmp_path / "out")
    written = files.write_files(I.to_png(images), out).collect()
    assert len(written) == 5
    back = files.decoded(spark, out)
    pairs = images.withColumn("name", F.substring_index("path", "/", -1)).join(
        back.select(F.substring_index("path", "/", -1).alias("name"), F.col("data").alias("again")), "name"
    )
    assert pairs.where("data = again").count() == 5
    assert I.sharpen_images(images).where(F.length("content") > 0).count() == 5


def test_same_names_in_several_folders(spark, folder, tmp_path):
    images = files.decoded(spark, str(folder), recursive=True)
    assert len(files.write_files(I.to_png(images), str(tmp_path / "flat"), flat=True).collect()) == 15
    assert len(list((tmp_path / "flat").iterdir())) == 15
