"""Band sets, homographies and geometry on the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.registry import bands, homographies, query, sql, table
from furrow.functions.geometry import decompose, project, squared_residual
from furrow.functions.text import band_number, group_key
from furrow.operators import bands as B
from furrow.operators import homography as G

WIDTH, HEIGHT = 1280, 960


def _files(spark, sf):
    """File names of the order lines, as they are (pairs repeat)."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("/field/day_1/IMG_"), F.col("l_orderkey").cast("string"), F.lit("_x_"), F.col("l_linenumber").cast("string"), F.lit(".png")).alias("path"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )


@query("p02_group_and_band", """select '/field/day_1/IMG_' || l_orderkey || '_x_' || l_linenumber || '.png' as path,
    l_orderkey || '_x' as group_key, l_linenumber as band, count(*) as n from lineitem group by 1, 2, 3""")
def _(spark, sf):
    named = _files(spark, sf).select("path", group_key(F.col("path")).alias("group_key"), band_number(F.col("path")).alias("band"))
    return named.groupBy("path", "group_key", "band").agg(F.count("*").alias("n"))


@query("a01_group_members", """select l_orderkey::VARCHAR as group_key, (row_number() over (partition by l_orderkey order by l_orderkey || '_' || l_linenumber) - 1)::BIGINT as pos,
    l_orderkey || '_' || l_linenumber as name, l_linenumber as band, count(*) over (partition by l_orderkey) as n_members from lineitem""")
def _(spark, sf):
    files = _files(spark, sf).select(
        F.col("l_orderkey").cast("string").alias("group_key"), F.col("l_linenumber").alias("band"),
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_extendedprice").alias("v"),
    )
    return B.group_members(files).select("group_key", "pos", "name", "band", "n_members")


@query("j10_names_with_images", sql("""select group_key, (row_number() over (partition by group_key order by name) - 1)::BIGINT as pos, name, band, v from bands""",
                                    "bands"))
def _(spark, sf):
    return B.group_members(bands(spark, sf)).select("group_key", "pos", "name", "band", "v")


@query("g20_first_of_group", sql("""select group_key, name, band, v from (select *, row_number() over (partition by group_key order by name) as i
    from bands) where i = 1""", "bands"))
def _(spark, sf):
    return B.first_of_group(bands(spark, sf), ["band", "v"])


@query("j08_aligned_bands", sql("select * from wide", "wide"))
def _(spark, sf):
    return B.align_bands(bands(spark, sf))


@query("x07_ndvi", sql("select group_key, y, x, round((b4 - b3) / nullif(b4 + b3, 0), 6) as ndvi from wide", "wide"))
def _(spark, sf):
    return B.with_ndvi(B.align_bands(bands(spark, sf))).select("group_key", "y", "x", F.round("ndvi", 6).alias("ndvi"))


@query("x08_ndvi_mask", sql("""select group_key, y, x, (case when n is null then null when n >= 0.3 and n <= 0.6 then 1 else 0 end)::INT as mask
    from (select *, (b4 - b3) / nullif(b4 + b3, 0) as n from wide)""", "wide"))
def _(spark, sf):
    return B.with_ndvi(B.align_bands(bands(spark, sf))).select("group_key", "y", "x", B.ndvi_mask(F.col("ndvi")).alias("mask"))


@query("x09_rgb", sql("select group_key, y, x, b3 as red, b2 as green, b1 as blue from wide", "wide"))
def _(spark, sf):
    rgb = B.with_rgb(B.align_bands(bands(spark, sf)))
    c = F.col("rgb")
    return rgb.select("group_key", "y", "x", c[0].alias("red"), c[1].alias("green"), c[2].alias("blue"))


def _points(spark, sf):
    """One match per order line: rates and prices as coordinates."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("group_key"), F.col("l_linenumber").alias("band"),
        F.col("l_quantity").alias("xs"), (F.col("l_extendedprice") / 1000.0).alias("ys"),
        (F.col("l_quantity") + F.col("l_discount") * 10.0).alias("xd"), (F.col("l_extendedprice") / 1000.0 + 1.0).alias("yd"),
        (F.col("l_linestatus") == "O").cast("int").alias("inlier"),
    )


POINTS = """, pts as (select l_orderkey::VARCHAR as group_key, l_linenumber as band, l_quantity as xs, l_extendedprice / 1000.0::DOUBLE as ys,
    l_quantity + l_discount * 10.0::DOUBLE as xd, l_extendedprice / 1000.0::DOUBLE + 1.0::DOUBLE as yd, l_linestatus = 'O' as inlier from lineitem),
  proj as (select p.*, (h0 * xs + h1 * ys + h2) / (h6 * xs + h7 * ys + h8) as px, (h3 * xs + h4 * ys + h5) / (h6 * xs + h7 * ys + h8) as py
    from pts p join hom using (group_key, band)),
  res as (select *, (xd - px) * (xd - px) + (yd - py) * (yd - py) as residual from proj)"""


def _with_points(final: str) -> str:
    return sql("", "hom").rstrip() + POINTS + "\n" + final


@query("x05_project_points", _with_points(
    "select group_key, band, xs, round(ys, 6) as ys, round(px, 6) as px, round(py, 6) as py, round(residual, 4) as residual from res"))
def _(spark, sf):
    joined = _points(spark, sf).join(homographies(spark, sf), ["group_key", "band"])
    xs, ys, xd, yd = (F.col(c) for c in ("xs", "ys", "xd", "yd"))
    px, py = project(F.col("h"), xs, ys)
    residual = squared_residual(F.col("h"), xs, ys, xd, yd)
    return joined.select(
        "group_key", "band", "xs", F.round(ys, 6).alias("ys"), F.round(px, 6).alias("px"), F.round(py, 6).alias("py"),
        F.round(residual, 4).alias("residual"),
    )


@query("a12_back_projection", _with_points("""select group_key, band, round(coalesce(sum(residual) filter (where inlier), 0), 4) as bp_error,
    count(*) filter (where inlier) as inliers from res group by 1, 2"""))
def _(spark, sf):
    return B.back_projection(_points(spark, sf), homographies(spark, sf)).withColumn("bp_error", F.round("bp_error", 4))


@query("x06_decomposed", sql("""select group_key, band, round(h2, 9) as shift_x, round(h5, 9) as shift_y, round(atan2(h1, h0), 6) as theta,
    round(sqrt(h0 * h0 + h1 * h1), 6) as scale_x, round((h0 * h4 - h1 * h3) / sqrt(h0 * h0 + h1 * h1), 6) as scale_y,
    round((h0 * h3 + h1 * h4) / (h0 * h4 - h1 * h3), 6) as shear from hom""", "hom"))
def _(spark, sf):
    parts = {name: F.round(c, 9 if "shift" in name else 6).alias(name) for name, c in decompose(F.col("h")).items()}
    return homographies(spark, sf).select("group_key", "band", *parts.values())


BOX = f"""select group_key, ceil(round(mx, 9))::BIGINT + r as x0, {WIDTH} - (ceil(round(mx, 9))::BIGINT + r) as x1,
    ceil(round(my, 9))::BIGINT + r as y0, {HEIGHT} - (ceil(round(my, 9))::BIGINT + r) as y1 from
    (select group_key, max(abs(h2)) as mx, max(abs(h5)) as my, ceil(round(sin(max(abs(atan2(h1, h0)))) * {WIDTH}, 9))::BIGINT as r from hom group by 1)"""


@query("a13_crop_box", sql(BOX, "hom"))
def _(spark, sf):
    return B.crop_box(homographies(spark, sf), WIDTH, HEIGHT)


@query("k04_registered_catalog", _with_points(f"""select e.group_key, e.band, x0, x1, y0, y1, '.png' as file_type,
    round(coalesce(e.err, 0), 4) as squared_sum_error, 'abc123' as commit_hash,
    '/out/IMG_' || e.group_key || '_' || e.band || '.png' as file_path
    from (select group_key, band, sum(residual) filter (where inlier) as err from res group by 1, 2) e join ({BOX}) using (group_key)"""))
def _(spark, sf):
    h = homographies(spark, sf)
    errors = B.back_projection(_points(spark, sf), h)
    rows = B.registered_catalog(B.crop_box(h, WIDTH, HEIGHT), errors, "/out", "abc123")
    return rows.withColumn("squared_sum_error", F.round("squared_sum_error", 4))


def _moved(i: int, x: int, y: int) -> str:
    w = f"(h6 * {x} + h7 * {y} + h8)"
    return f"(h0 * {x} + h1 * {y} + h2) / {w} as x{i}, (h3 * {x} + h4 * {y} + h5) / {w} as y{i}"


@query("x18_canvas", sql(f"""select group_key, band, hx - lx as width, hy - ly as height, -lx as offset_x, -ly as offset_y from (select group_key, band,
    trunc(round(least(0, x0, x1, x2, x3) - 0.5::DOUBLE, 6))::INT as lx, trunc(round(greatest({WIDTH}, x0, x1, x2, x3) + 0.5::DOUBLE, 6))::INT as hx,
    trunc(round(least(0, y0, y1, y2, y3) - 0.5::DOUBLE, 6))::INT as ly, trunc(round(greatest({HEIGHT}, y0, y1, y2, y3) + 0.5::DOUBLE, 6))::INT as hy
    from (select group_key, band, {_moved(0, 0, 0)}, {_moved(1, 0, HEIGHT)}, {_moved(2, WIDTH, 0)}, {_moved(3, WIDTH, HEIGHT)} from hom))""", "hom"))
def _(spark, sf):
    return B.canvas(homographies(spark, sf), WIDTH, HEIGHT)


def _corner_points(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"),
    )


CORNER_SQL = """with p as (select l_orderkey, l_quantity as x, l_extendedprice / 1000.0::DOUBLE as y,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos from lineitem),
  c as (select l_orderkey, first(x order by x + y, pos) as tlx, first(y order by x + y, pos) as tly,
    first(x order by y - x, pos) as trx, first(y order by y - x, pos) as try_, first(x order by x + y desc, pos) as brx,
    first(y order by x + y desc, pos) as bry, first(x order by y - x desc, pos) as blx, first(y order by y - x desc, pos) as bly
    from p group by 1)"""


def _corners(spark, sf):
    return B.ordered_corners(_corner_points(spark, sf), "l_orderkey")


@query("x13_point_order", CORNER_SQL + """ select l_orderkey, tlx as tl_x, tly as tl_y, trx as tr_x, try_ as tr_y, brx as br_x, bry as br_y,
    blx as bl_x, bly as bl_y from c""")
def _(spark, sf):
    flat = [F.col(f"{p}.{a}").alias(f"{p}_{a}") for p in ("tl", "tr", "br", "bl") for a in ("x", "y")]
    return _corners(spark, sf).select("l_orderkey", *flat)


@query("x14_rectified_size", CORNER_SQL + """ select l_orderkey, greatest(abs(trunc(brx - blx)::INT), abs(trunc(trx - tlx)::INT)) as width,
    greatest(abs(trunc(bry - try_)::INT), abs(trunc(bly - tly)::INT)) as height from c""")
def _(spark, sf):
    return B.rectified_size(_corners(spark, sf)).select("l_orderkey", "width", "height")


# One transform per supplier, and its order lines as matches, four in ten of them off.
SCALE_X, SCALE_Y = "(1 + l_suppkey % 7 / 100.0::DOUBLE)", "(l_suppkey % 5 / 100.0::DOUBLE)"
FITTED = f"""with m as (select l_suppkey::VARCHAR as group_key, count(*) as n, count(*) filter (where (l_orderkey * 7 + l_linenumber * 3) % 10 >= 4) as good,
    any_value({SCALE_X}) as a, any_value({SCALE_Y}) as b, any_value(l_suppkey % 50) as c, any_value(l_suppkey % 30) as d from lineitem group by 1)"""


def supplier_matches(spark, sf):
    key = F.col("l_suppkey")
    a, b = F.lit(1) + key % 7 / F.lit(100.0), key % 5 / F.lit(100.0)
    line = table(spark, sf, "lineitem").withColumns({"xs": (F.col("l_partkey") * 37 % 1000).cast("double"), "ys": F.floor(F.col("l_extendedprice")) % 997 * F.lit(1.0)})
    off = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 10 < 4
    away = F.when(off, F.lit(100.0) + F.col("l_orderkey") * 13 % 600).otherwise(0.0)
    return line.select(
        key.cast("string").alias("group_key"), F.lit(1).alias("band"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kp"), "xs", "ys",
        (a * F.col("xs") - b * F.col("ys") + key % 50 + away).alias("xd"), (b * F.col("xs") + a * F.col("ys") + key % 30 - away).alias("yd"),
    )


def _fitted(spark, sf):
    matches = supplier_matches(spark, sf)
    return G.with_target(G.fit_homographies(matches), matches.select("group_key").distinct(), 0)


@query("g08_fitted_homographies", FITTED + """ select group_key, 1 as band, [round(a, 3), round(-b, 3) + 0, c, round(b, 3), round(a, 3), d, 0, 0, 1]::DOUBLE[] as h,
    0.0::DOUBLE as bp_error, good as inliers from m union all select group_key, 0, [1, 0, 0, 0, 1, 0, 0, 0, 1]::DOUBLE[], 0.0, 0 from m""")
def _(spark, sf):
    """Fitted transforms to three digits, and the matches that agree."""
    h = F.transform("h", lambda v: F.round(v, 3) + 0.0)
    return _fitted(spark, sf).select("group_key", "band", h.alias("h"), (F.round("bp_error", 3) + 0.0).alias("bp_error"), "inliers")


@query("g19_registration_fit", FITTED + f""" select group_key, ceil(round(c, 3))::BIGINT + r as x0, {WIDTH} - (ceil(round(c, 3))::BIGINT + r) as x1,
    ceil(round(d, 3))::BIGINT + r as y0, {HEIGHT} - (ceil(round(d, 3))::BIGINT + r) as y1
    from (select *, ceil(round(sin(abs(atan2(-round(b, 5), round(a, 5)))) * {WIDTH}, 9))::BIGINT as r from m)""")
def _(spark, sf):
    """Registration up to the crop box of the fitted bands."""
    fitted = _fitted(spark, sf).withColumn("h", F.transform("h", lambda v: F.round(v, 5) + 0.0))
    return B.crop_box(fitted.where(F.col("h").isNotNull()), WIDTH, HEIGHT)
