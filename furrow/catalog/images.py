"""Pixels, histograms and the flower pipeline on the 8 x 8 stand-in images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.catalog.registry import CORNERS, HEIGHT, WIDTH, grey, inside_sql, query, sql, table
from furrow.functions import colour
from furrow.operators import bands as B
from furrow.operators import histograms as H
from furrow.operators import images as I
from furrow.operators import pixels as P
from furrow.operators import tiles as R
from furrow.operators import vectors as V
from furrow.operators.ordered import row_index
from furrow.plans import jobs
from furrow.plans.steps import Step, run_steps
from furrow.session import default_slices, new_folder, stored
from furrow.sources import files as S

CELLS = [[0, 1, 0], [1, 0, 1], [0, 1, 0]]
CENTRE = [[0, 0, 0], [0, 1, 0], [0, 0, 0]]


def masked(spark, sf) -> DataFrame:
    return P.in_mask(grey(spark, sf), CORNERS, WIDTH, HEIGHT)


def hist(spark, sf) -> DataFrame:
    return H.histogram(masked(spark, sf))


def hists(spark, sf) -> DataFrame:
    """Dense histograms, written once for all their uses; the stand-in has one channel for both roles."""
    return stored(H.dense(hist(spark, sf)))


def both(spark, sf) -> DataFrame:
    return hists(spark, sf).select("image_id", F.col("hist").alias("hist_g"), F.col("hist").alias("hist_b"))


def rgb(spark, sf) -> DataFrame:
    """Three byte channels from the integer parts of order lines."""
    li = table(spark, sf, "lineitem")
    channel = lambda c: (F.floor(F.col(c)).cast("long") % 256).cast("int")
    return li.select(
        F.col("l_orderkey").alias("k"), channel("l_extendedprice").alias("b"), channel("l_partkey").alias("g"),
        (channel("l_quantity") * 5 % 256).alias("r"),
    ).distinct()


RGB_SQL = """with c as (select distinct l_orderkey as k, (floor(l_extendedprice)::BIGINT % 256)::INT as b, (l_partkey % 256)::INT as g,
    (floor(l_quantity)::BIGINT * 5 % 256)::INT as r from lineitem)"""
LINEAR = "case when {c} / 255.0::DOUBLE <= 0.04045 then {c} / 255.0::DOUBLE / 12.92 else pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) end"
ROOT = "case when {t} > 0.008856 then pow({t}, 1.0::DOUBLE / 3) else {t} * 7.787 + 16.0::DOUBLE / 116 end"


@query("g01_plot_mask", sql(f"select image_id, y, x, ({inside_sql()}) as inside from grey", "grey"))
def _(spark, sf):
    return grey(spark, sf).select(
        "image_id", "y", "x", P.inside_region(F.col("x"), F.col("y"), CORNERS, WIDTH, HEIGHT).alias("inside")
    )


def _cells_sql(matrix) -> str:
    return " or ".join(f"({inside_sql(c)})" for c in P.region_cells(matrix, CORNERS))


@query("g02_region_matrix", sql(f"select image_id, y, x, v from grey where {_cells_sql(CELLS)}", "grey"))
def _(spark, sf):
    return P.in_region_matrix(grey(spark, sf), CELLS, CORNERS, WIDTH, HEIGHT)


@query("f04_masked_pixels", sql("select image_id, y, x, v from masked", "masked"))
def _(spark, sf):
    return masked(spark, sf)


@query("a04_histogram", sql(
    "select i.image_id, b.bin::INT as bin, coalesce(h.n, 0) as n from (select distinct image_id from hist) i "
    "cross join (select unnest(range(256)) as bin) b left join hist h on h.image_id = i.image_id and h.bin = b.bin", "hist"))
def _(spark, sf):
    return H.zero_filled(hist(spark, sf))


@query("a02_mean_vector", sql("select pos::INT as pos, round(avg(e), 6) as mean from px group by 1", "px"))
def _(spark, sf):
    return H.mean_vector(table(spark, sf, "embeddings"), "embedding").select("pos", F.round("mean", 6).alias("mean"))


@query("a03_sum_vector", sql("select bin::INT as pos, n::DOUBLE as total from tot union all "
       "select b, 0.0 from (select unnest(range(256))::INT as b) where b not in (select bin from tot)", "tot"))
def _(spark, sf):
    return H.sum_vector(hists(spark, sf), "hist")


@query("a05_corrupt_score", sql("select image_id, round(score, 6) as score from score", "score"))
def _(spark, sf):
    return hists(spark, sf).select("image_id", F.round(H.corrupt_score(F.col("hist")), 6).alias("score"))


@query("f01_sound_images", sql("select image_id from score where score < 0.2", "score"))
def _(spark, sf):
    return hists(spark, sf).where(~H.is_corrupt(F.col("hist"))).select("image_id")


@query("x11_best_lag", sql("select image_id, lag::INT as lag from lagged", "lagged"))
def _(spark, sf):
    h = hists(spark, sf)
    _, reference = H.first_histogram(h)
    return h.select("image_id", H.best_lag_to(F.col("hist"), reference).alias("lag"))


@query("x12_shift_threshold", sql(
    "select image_id, lag::INT as lag, ref_lag::INT as ref_lag, shift::INT as shift, ((155 + shift) % 256)::INT as threshold from shifted",
    "shifted"))
def _(spark, sf):
    return H.shifts(hists(spark, sf)).select(
        "image_id", "lag", "ref_lag", "shift", H.threshold(F.col("shift")).alias("threshold")
    )


@query("j02_reference_on_rows", sql(
    "select image_id, ref_lag::INT as ref_lag, (select sum(n) from ref)::BIGINT as ref_pixels from lagged, reflag", "lagged", "reflag"))
def _(spark, sf):
    h = hists(spark, sf)
    _, reference = H.first_histogram(h)
    return H.shifts(h).select("image_id", "ref_lag", F.lit(sum(reference)).cast("long").alias("ref_pixels"))


@query("a06_flower_pixels", sql("select image_id, shift::INT as shift, n_yellow from yellow", "yellow"))
def _(spark, sf):
    return H.shifts(hists(spark, sf)).select(
        "image_id", "shift", H.flower_pixels(F.col("hist"), F.col("shift")).alias("n_yellow")
    )


SIGNED = """meancorr as (select h.image_id, h.bin - t.bin + 255 as k, sum(h.n * t.n) as c from hist h, tot t group by 1, 2),
meanlag as (select image_id, k % 256 as low from (select *, row_number() over (partition by image_id order by c desc, k) as i
    from meancorr) where i = 1),
signed as (select image_id, case when low > 127 then low - 256 else low end as shift from meanlag),
share as (select s.image_id, s.shift, coalesce(sum(h.n) filter (where h.bin >= 155 + s.shift and h.bin <= 255 + s.shift), 0) as inside
    from signed s join hist h using (image_id) group by 1, 2)"""


def _share_sql(final: str) -> str:
    return sql("", "tot").rstrip() + ",\n" + SIGNED + "\n" + final


@query("a07_flower_share", _share_sql("select image_id, round(inside / 25.0::DOUBLE, 6) as share from share"))
def _(spark, sf):
    h = H.shifts_to_mean(hists(spark, sf))
    return h.select("image_id", F.round(H.flower_share(F.col("hist"), F.col("shift"), F.lit(25)), 6).alias("share"))


@query("g18_flower_percentage", _share_sql(
    "select image_id, shift::INT as shift, round(inside / (select count(*) from grey where image_id = (select min(image_id) from grey)"
    f" and {inside_sql()})::DOUBLE, 6) as share from share"))
def _(spark, sf):
    pixels = masked(spark, sf)
    first = pixels.where(F.col("image_id") == pixels.agg(F.min("image_id")).scalar())
    return jobs.flower_percentage(hists(spark, sf), first.agg(F.count("*")).scalar()).withColumn("share", F.round("share", 6))


@query("o01_sorted_by_pixels", sql("select image_id, n_yellow from sound order by n_yellow, image_id", "sound"))
def _(spark, sf):
    return jobs.flower_pixels(both(spark, sf)).select("image_id", "n_yellow").orderBy("n_yellow", "image_id")


@query("f08_no_flowers_no_search", sql(
    "select image_id, case when n_yellow = 0 then 'skipped' else 'searched' end as step from sound", "sound"))
def _(spark, sf):
    return jobs.flower_pixels(both(spark, sf)).select(
        "image_id", F.when(F.col("n_yellow") == 0, "skipped").otherwise("searched").alias("step")
    )


def _lloyd_sql(source: str, k: int, steps: int, prefix: str) -> str:
    """CTEs of evenly spaced starts and fixed Lloyd steps on ``n_yellow`` of ``source``."""
    parts = [
        f"{prefix}0 as (select i as k, lo + (hi - lo) * (i + 0.5::DOUBLE) / {k} as c from "
        f"(select min(n_yellow)::DOUBLE as lo, max(n_yellow)::DOUBLE as hi from {source}), (select unnest(range({k})) as i))"
    ]
    for s in range(steps):
        parts.append(
            f"{prefix}{s + 1} as (select p.k, coalesce(m.c, p.c) as c from {prefix}{s} p left join (select k, avg(x) as c from "
            f"(select n.image_id, n.n_yellow::DOUBLE as x, p.k, row_number() over (partition by n.image_id order by "
            f"abs(n.n_yellow - p.c), p.k) as i from {source} n, {prefix}{s} p) where i = 1 group by k) m using (k))"
        )
    last = f"{prefix}{steps}"
    parts.append(
        f"{prefix}c as (select image_id, n_yellow, k as cluster from (select n.image_id, n.n_yellow, p.k, row_number() over "
        f"(partition by n.image_id order by abs(n.n_yellow - p.c), p.k) as i from {source} n, {last} p) where i = 1)"
    )
    return ",\n".join(parts)


@query("g13_line_clusters", sql("", "sound").rstrip() + ",\n" + _lloyd_sql("sound", 4, 10, "a")
       + "\nselect image_id, n_yellow, cluster::INT as cluster from ac")
def _(spark, sf):
    scored = jobs.flower_pixels(both(spark, sf))
    return V.nearest_value(scored, V.fit_line(scored, "n_yellow", 4, 10), "n_yellow").select("image_id", "n_yellow", "cluster")


@query("f03_lowest_cluster", sql("", "sound").rstrip() + ",\n" + _lloyd_sql("sound", 4, 10, "a")
       + "\nselect image_id, n_yellow from ac where cluster = 0")
def _(spark, sf):
    scored = jobs.flower_pixels(both(spark, sf))
    return jobs.in_lowest_cluster(scored, V.fit_line(scored, "n_yellow", 4)).select("image_id", "n_yellow")


@query("g16_flower_selection", sql("", "sound").rstrip() + ",\n" + _lloyd_sql("sound", 4, 10, "a")
       + ",\nfirst as (select image_id, n_yellow from ac where cluster = 0),\n" + _lloyd_sql("first", 2, 10, "b")
       + "\nselect image_id, n_yellow from bc where cluster = 0 order by n_yellow, image_id")
def _(spark, sf):
    return jobs.selected_images(both(spark, sf)).select("image_id", "n_yellow")


G17_SQL = """,
data as (select h.*, e.label as dataset from hist h join embeddings e on e.vec_id = h.image_id),
firsts as (select dataset, min(image_id) as f from data group by 1),
refs as (select d.dataset, d.bin, d.n from data d join firsts f on f.dataset = d.dataset and f.f = d.image_id),
tots as (select dataset, bin, sum(n) as n from data group by 1, 2),
rl as (select dataset, k as ref_lag from (select r.dataset, r.bin - t.bin + 255 as k, row_number() over (partition by r.dataset
    order by sum(r.n * t.n) desc, r.bin - t.bin + 255) as i from refs r join tots t using (dataset) group by r.dataset, r.bin - t.bin + 255)
    where i = 1),
il as (select dataset, image_id, k as lag from (select d.dataset, d.image_id, d.bin - r.bin + 255 as k, row_number() over
    (partition by d.image_id order by sum(d.n * r.n) desc, d.bin - r.bin + 255) as i from data d join refs r using (dataset)
    group by d.dataset, d.image_id, d.bin - r.bin + 255) where i = 1),
sh as (select il.dataset, il.image_id, ((case when il.image_id = f.f then 0 else lag end) + ref_lag) % 256 as shift
    from il join rl using (dataset) join firsts f using (dataset))
select sh.dataset, sh.image_id, sh.shift::INT as shift,
    coalesce(sum(d.n) filter (where d.bin >= (155 + sh.shift) % 256), 0)::BIGINT as n_yellow
from sh join data d using (image_id) join score s using (image_id) where s.score < 0.2 group by 1, 2, 3"""


@query("g17_flower_pixels_per_dataset", sql("", "score").rstrip() + G17_SQL)
def _(spark, sf):
    label = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("dataset"))
    return jobs.flower_pixels_by(both(spark, sf).join(label, "image_id"), "dataset", "image_id")


@query("a26_image_count", sql("select count(distinct image_id) as images from grey", "grey"))
def _(spark, sf):
    return grey(spark, sf).select("image_id").distinct().agg(F.count("*").alias("images"))


@query("o05_argmax", sql(
    "select image_id, bin, n from (select *, row_number() over (partition by image_id order by n desc, bin) as i from hist) where i = 1",
    "hist"))
def _(spark, sf):
    h = hist(spark, sf)
    return h.groupBy("image_id").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"))


@query("o02_first_record", sql("select image_id, sum(n)::BIGINT as pixels from hist where image_id = (select min(image_id) from hist) group by 1",
                               "hist"))
def _(spark, sf):
    first = hist(spark, sf).groupBy("image_id").agg(F.sum("n").alias("pixels"))
    return first.orderBy("image_id").limit(1)


@query("w01_row_index", """select page_id, url, (row_number() over (order by url, page_id) - 1)::BIGINT as row_index,
    row_number() over (order by url, page_id) = 1 as is_first from pages""")
def _(spark, sf):
    return row_index(table(spark, sf, "pages").select("page_id", "url"), "url", "page_id").withColumn(
        "is_first", F.col("row_index") == 0
    )


@query("u01_reference_row_union", sql(
    "select 'reference' as role, image_id, bin, n from hist where image_id = (select min(image_id) from hist) union all "
    "select 'image', image_id, bin, n from hist where image_id <> (select min(image_id) from hist)", "hist"))
def _(spark, sf):
    h = hist(spark, sf)
    first = h.agg(F.min("image_id")).scalar()
    part = lambda role, keep: h.where(keep).select(F.lit(role).alias("role"), "image_id", "bin", "n")
    return part("reference", F.col("image_id") == first).unionByName(part("image", F.col("image_id") != first))


@query("j01_state_by_key", sql(
    "select m.image_id, m.y, m.x, m.v, s.shift::INT as shift, m.v >= (155 + s.shift) % 256 as flower from masked m join shifted s using (image_id)",
    "shifted"))
def _(spark, sf):
    state = H.shifts(hists(spark, sf)).select("image_id", "shift")
    return masked(spark, sf).join(state, "image_id").withColumn("flower", F.col("v") >= H.threshold(F.col("shift")))


@query("x01_grey", RGB_SQL + " select *, floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5::DOUBLE)::INT as grey from c")
def _(spark, sf):
    return rgb(spark, sf).withColumn("grey", colour.grey(F.col("b"), F.col("g"), F.col("r")))


@query("x02_lab_b", RGB_SQL + f""", l as (select *, {LINEAR.format(c="b")} as lb, {LINEAR.format(c="g")} as lg, {LINEAR.format(c="r")} as lr from c),
    yz as (select *, lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE as yy,
      (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.088754::DOUBLE as zz from l)
    select k, b, g, r, greatest(least(floor((({ROOT.format(t="yy")}) - ({ROOT.format(t="zz")})) * 200.0::DOUBLE + 128.5::DOUBLE), 255), 0)::INT as lab_b
    from yz""")
def _(spark, sf):
    return rgb(spark, sf).withColumn("lab_b", colour.lab_b(F.col("b"), F.col("g"), F.col("r")))


@query("x03_highlight", sql(
    "select m.image_id, m.y, m.x, floor(1.0::DOUBLE / (1.0::DOUBLE + exp((m.v - (149 + s.shift) % 256) * (ln(1 / 0.99::DOUBLE - 1) / 6)))"
    " * 255.0::DOUBLE)::INT as v from grey m join shifted s using (image_id)", "shifted"))
def _(spark, sf):
    state = H.shifts(hists(spark, sf)).select("image_id", "shift")
    return grey(spark, sf).join(state, "image_id").select("image_id", "y", "x", colour.highlight(F.col("v"), F.col("shift")).alias("v"))


@query("x04_intensity_ramp", sql(
    "select m.image_id, m.y, m.x, round(greatest(least((greatest(least(v, t + 10), 0) - (t - 8)) / (t + 10)::DOUBLE, 1), 0), 6) as ramp from "
    "(select m.*, (155 + s.shift) % 256 as t from grey m join shifted s using (image_id)) m", "shifted"))
def _(spark, sf):
    state = H.shifts(hists(spark, sf)).select("image_id", "shift")
    ramp = colour.intensity_ramp(F.col("v"), H.threshold(F.col("shift")))
    return grey(spark, sf).join(state, "image_id").select("image_id", "y", "x", F.round(ramp, 6).alias("ramp"))


@query("x10_crop", sql("select image_id, y, x, v from grey where x >= 2 and x < 6 and y >= 1 and y < 5", "grey"))
def _(spark, sf):
    return P.crop(grey(spark, sf), 2, 6, 1, 5)


@query("x15_lens_correction", sql("""select w.image_id, w.y, w.x, g.v from (select image_id, y, x,
      trunc(4 + th * (x - 4))::INT as sx, trunc(4 + th * (y - 4))::INT as sy from
      (select *, case when r = 0 then 1 else atan(r) / nullif(r, 0) end as th from
        (select *, sqrt(((x - 4) * (x - 4) + (y - 4) * (y - 4))::DOUBLE) / (sqrt(128::DOUBLE) / 0.5) as r from grey))) w
    join grey g on g.image_id = w.image_id and g.x = w.sx and g.y = w.sy""", "grey"))
def _(spark, sf):
    return P.fix_distortion(grey(spark, sf), WIDTH, HEIGHT, 0.5)


@query("x16_crop_black", sql("""select g.image_id, g.y, g.x, g.v from dark g join (select image_id, min(x) as x0, max(x) as x1, min(y) as y0,
      max(y) as y1 from dark where v > 1 group by 1) b using (image_id) where g.x between x0 and x1 - 1 and g.y between y0 and y1 + 1""",
    "grey").replace("\nselect g.image_id", ",\ndark as (select image_id, y, x, greatest(v - 150, 0) as v from grey)\nselect g.image_id"))
def _(spark, sf):
    return P.crop_black(grey(spark, sf).withColumn("v", F.greatest(F.col("v") - 150, F.lit(0))))


@query("x17_overlay", sql("""select b.image_id, b.y, b.x, case when f.v > 10 then f.v else b.v end as v from grey b
    left join (select image_id, y, x, v from masked where v % 2 = 0) f using (image_id, y, x)""", "masked"))
def _(spark, sf):
    return P.overlay(grey(spark, sf), masked(spark, sf).where(F.col("v") % 2 == 0))


SMOOTH_SQL = """,
k as (select unnest([-2, -1, 0, 1, 2]) as d, unnest([0.0625, 0.25, 0.375, 0.25, 0.0625])::DOUBLE as w),
pass_y as (select o.image_id, o.y, o.x, sum(k.w * s.v) as v from grey o, k join grey s on s.image_id = o.image_id and s.x = o.x
    and s.y = case when (o.y + k.d + 14) % 14 < 8 then (o.y + k.d + 14) % 14 else 14 - (o.y + k.d + 14) % 14 end group by 1, 2, 3),
soft as (select o.image_id, o.y, o.x, floor(sum(k.w * s.v) + 0.5::DOUBLE)::INT as v from pass_y o, k join pass_y s on s.image_id = o.image_id
    and s.y = o.y and s.x = case when (o.x + k.d + 14) % 14 < 8 then (o.x + k.d + 14) % 14 else 14 - (o.x + k.d + 14) % 14 end group by 1, 2, 3)"""


@query("g03_otsu_threshold", sql("", "grey").rstrip() + SMOOTH_SQL + """,
sh as (select image_id, v as bin, count(*) as n from soft group by 1, 2),
run as (select image_id, bin, sum(n) over (partition by image_id order by bin) as w, sum(n * bin) over (partition by image_id order by bin) as m,
    sum(n) over (partition by image_id) as t, sum(n * bin) over (partition by image_id) as mass from sh),
sp as (select image_id, bin, coalesce(round((m * t - w * mass)::DOUBLE * (m * t - w * mass)::DOUBLE / nullif(w * (t - w), 0)::DOUBLE, 6), -1) as s from run)
select image_id, bin as level from (select *, row_number() over (partition by image_id order by s desc, bin) as i from sp) where i = 1""")
def _(spark, sf):
    return H.otsu_threshold(H.histogram(P.smooth(grey(spark, sf))))


def _blur_sql(name: str, source: str, sigma: float, size: int) -> str:
    kernel = P.gaussian_kernel(sigma)
    r = len(kernel) // 2
    ds, ws = list(range(-r, r + 1)), [repr(w) for w in kernel]
    fold = lambda a: (f"case when ((({a}) % {2 * size}) + {2 * size}) % {2 * size} < {size} then ((({a}) % {2 * size}) + {2 * size}) % {2 * size} "  # noqa: E731
                      f"else {2 * size - 1} - ((({a}) % {2 * size}) + {2 * size}) % {2 * size} end")
    return (
        f"{name}k as (select unnest({ds}) as d, unnest([{', '.join(ws)}])::DOUBLE as w),\n"
        f"{name}y as (select o.image_id, o.y, o.x, sum(k.w * s.v) as v from {source} o, {name}k k join {source} s on s.image_id = o.image_id "
        f"and s.x = o.x and s.y = {fold('o.y + k.d')} group by 1, 2, 3),\n"
        f"{name} as (select o.image_id, o.y, o.x, sum(k.w * s.v) as v from {name}y o, {name}k k join {name}y s on s.image_id = o.image_id "
        f"and s.y = o.y and s.x = {fold('o.x + k.d')} group by 1, 2, 3)"
    )


@query("g04_sharpen", sql("", "grey").rstrip() + ",\n" + _blur_sql("s1", "grey", 3.0, 8) + ",\n" + _blur_sql("s2", "s1", 1.0, 8)
       + "\nselect s1.image_id, s1.y, s1.x, round(s1.v + (s1.v - s2.v) * 30, 4) as v from s1 join s2 using (image_id, y, x)")
def _(spark, sf):
    return P.sharpen(grey(spark, sf)).withColumn("v", F.round("v", 4))


@query("g06_local_maxima", sql("""select g.image_id, g.y, g.x, g.v from grey g join grey n on n.image_id = g.image_id
    and n.y between g.y - 1 and g.y + 1 and n.x between g.x - 1 and g.x + 1 and not (n.x = g.x and n.y = g.y)
    group by 1, 2, 3, 4 having g.v > max(n.v)""", "grey"))
def _(spark, sf):
    return P.local_maxima(grey(spark, sf))


TURN = [0.96, -0.28, 1.5, 0.28, 0.96, -0.5, 0.0, 0.0, 1.0]


@query("g09_warp", sql("""select image_id, y, x, round(sum(w * coalesce(v, 0)), 6) as v from (
    select o.image_id, o.y, o.x, c.w, s.v from (select *, round((0.96 * (x - 1.5) + 0.28 * (y + 0.5))::DOUBLE, 9) as u,
        round((-0.28 * (x - 1.5) + 0.96 * (y + 0.5))::DOUBLE, 9) as t from grey) o,
    lateral (select unnest([0, 1, 0, 1]) as a, unnest([0, 0, 1, 1]) as b,
        unnest([(1 - (u - floor(u))) * (1 - (t - floor(t))), (u - floor(u)) * (1 - (t - floor(t))), (1 - (u - floor(u))) * (t - floor(t)),
          (u - floor(u)) * (t - floor(t))]) as w) c
    left join grey s on s.image_id = o.image_id and s.x = floor(u) + c.a and s.y = floor(t) + c.b) group by 1, 2, 3""", "grey"))
def _(spark, sf):
    px = grey(spark, sf)
    turned = px.select("image_id").distinct().withColumn("h", F.array(*[F.lit(v) for v in TURN]))
    return P.warp(px, turned, WIDTH, HEIGHT).withColumn("v", F.round("v", 6))


def planes(spark, sf, scaled: int = 8) -> DataFrame:
    """Each grey image as one byte row, enlarged ``scaled`` times (8: a 64 x 64 picture)."""
    e = grey(spark, sf)
    # both groupings below and the per-image work behind them share this one partitioning
    e = e.repartition(default_slices(e), "image_id")
    line = e.groupBy("image_id", "y").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: F.repeat(F.lpad(F.hex(s["v"]), 2, "0"), scaled)), "").alias("row")
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda s: F.repeat(s["row"], scaled)), "")
    return line.groupBy("image_id").agg(F.unhex(text).alias("data")).select(
        "image_id", F.lit(HEIGHT * scaled).alias("height"), F.lit(WIDTH * scaled).alias("width"), "data"
    )


@query("g07_checked_steps", sql("select image_id, bin, n from hist", "hist"))
def _(spark, sf):
    steps = [
        Step("plot mask", ("image_id", "y", "x", "v"), lambda d: P.in_mask(d, CORNERS, WIDTH, HEIGHT)),
        Step("histogram", ("image_id", "v"), H.histogram),
    ]
    return run_steps(grey(spark, sf), steps)


def _image_folder(spark, sf, *channels) -> str:
    """The stand-in images as 8-bit colour files, blue, green and red by the given functions of their grey. Every fifth
    file is cut in its middle, and every seventh holds text; returns the folder."""
    folder, k = new_folder(spark), F.col("image_id")
    samples = F.concat(*[F.lpad(F.hex(c(F.col("v"))), 2, "0") for c in channels])
    packed = grey(spark, sf).select("image_id", F.struct("y", "x", samples.alias("s")).alias("p"))
    # as many entries as an image has pixels
    data = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), ""))
    name = F.concat(F.lit("/"), F.lpad(k.cast("string"), 12, "0"), F.lit(".png"))
    images = packed.groupBy("image_id").agg(data.alias("data")).select(name.alias("path"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), "data")
    files = I.to_png(images).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))
    cut = F.when(k % 7 == 0, F.lit("no image").cast("binary")).when(k % 5 == 0, F.expr("substring(content, 1, length(content) div 2)")).otherwise(F.col("content"))
    S.write_files(files.select("path", cut.alias("content")), folder).count()
    return folder


def _image_id(path: str):
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long").alias("image_id")


@query("s02_decoded_images", sql("select image_id, y, x, v as b, 255 - v as g, (v * 7 % 256)::INT as r from grey where image_id % 5 <> 0 and image_id % 7 <> 0", "grey"))
def _(spark, sf):
    """A folder of image files, decoded by Spark's image source; broken files are left out."""
    folder = _image_folder(spark, sf, lambda v: v, lambda v: 255 - v, lambda v: v * 7 % 256)
    pixel = S.decoded(spark, folder).select(_image_id("path"), "width", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("at"), "data")
    sample = lambda c: F.conv(F.hex(F.expr(f"substring(data, at * 3 + {c + 1}, 1)")), 16, 10).cast("int")
    return pixel.select(
        "image_id", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).alias("x"),
        sample(0).alias("b"), sample(1).alias("g"), sample(2).alias("r"),
    )


@query("s02_dropped_files", "select count(*) as files, count(*) filter (where vec_id % 5 <> 0 and vec_id % 7 <> 0) as decoded from embeddings")
def _(spark, sf):
    folder = _image_folder(spark, sf, *[lambda v: v] * 3)
    read = S.decoded(spark, folder).select("path").withColumn("ok", F.lit(1))
    return S.scan(spark, folder).select("path").withColumn("ok", F.lit(None).cast("int")).union(read).agg(
        F.count_if(F.col("ok").isNull()).alias("files"), F.count("ok").alias("decoded")
    )


@query("g16_folder_selection", sql("", "sound").rstrip().replace("from embeddings", "from embeddings where vec_id % 5 <> 0 and vec_id % 7 <> 0") + ",\n" + _lloyd_sql("sound", 4, 10, "a")
       + ",\nfirst as (select image_id, n_yellow from ac where cluster = 0),\n" + _lloyd_sql("first", 2, 10, "b")
       + "\nselect image_id, n_yellow from bc where cluster = 0")
def _(spark, sf):
    """From a folder of files to the images chosen by their flower pixels. The files are grey, so their grey histogram
    takes the place of the colour one too."""
    # the grey values are scaled by the extremes of all images that can be read
    sound = table(spark, sf, "embeddings").where("vec_id % 5 <> 0 and vec_id % 7 <> 0")
    folder = new_folder(spark)
    sound.write.parquet(f"{folder}/embeddings.parquet")
    images = S.decoded(spark, _image_folder(spark, folder, *[lambda v: v] * 3))
    hists = stored(I.image_histograms(images, CORNERS)).select("path", "hist_g", F.col("hist_g").alias("hist_b"))
    return jobs.selected_images(hists, "path").select(_image_id("path"), "n_yellow")


@query("g05_blobs")
def _(spark, sf):
    return I.blobs_of_planes(planes(spark, sf)).select("image_id", F.inline("blobs"))


@query("a08_blob_count")
def _(spark, sf):
    return I.blobs_of_planes(planes(spark, sf)).select("image_id", "n_blobs")


@query("g11_png_round_trip", sql("select * from grey", "grey"))
def _(spark, sf):
    files = I.grey_to_png(planes(spark, sf, 1), "image_id", "BIGINT")
    return _unpacked(I.decode_grey(files, "image_id", "BIGINT"), 255.0)


def _unpacked(decoded: DataFrame, scale: float) -> DataFrame:
    cell = decoded.select("image_id", "width", F.posexplode("v").alias("pos", "v"))
    return cell.select(
        "image_id", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).alias("x"),
        F.round(F.col("v") * scale).cast("int").alias("v"),
    )


@query("s03_sixteen_bit_bands", sql("select image_id, y, x, (v * 256 + x)::INT as v from grey", "grey"))
def _(spark, sf):
    e = grey(spark, sf).withColumn("s", F.col("v") * 256 + F.col("x"))
    low_first = lambda s: F.concat(F.lpad(F.hex(s["s"] % 256), 2, "0"), F.lpad(F.hex(F.floor(s["s"] / 256)), 2, "0"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "s"))), low_first), "")
    rows = e.groupBy("image_id").agg(F.unhex(text).alias("data")).withColumns({"height": F.lit(HEIGHT), "width": F.lit(WIDTH)})
    files = I.grey_to_png(rows, "image_id", "BIGINT", 16)
    return _unpacked(I.decode_grey(files, "image_id", "BIGINT"), 65535.0)


def _band_files(spark, sf) -> DataFrame:
    """Five consecutive images as the bands of a group, as 8-bit PNG files."""
    group, band = F.floor(F.col("image_id") / 5).cast("string"), (F.col("image_id") % 5 + 1).cast("int")
    return I.grey_to_png(planes(spark, sf, 1), "image_id", "BIGINT").select(
        group.alias("group_key"), band.alias("band"), F.concat_ws("_", group, band.cast("string")).alias("name"), "content"
    )


PRODUCTS_SQL = sql("""select 'IMG_' || g || '_' || b as name, y, x, v::INT as value from moved union all
    select 'IMG_' || g || '_NDVI', y, x, coalesce(greatest(round_even((n.v * 257 / 65535.0::DOUBLE - r.v * 257 / 65535.0::DOUBLE) / nullif(n.v * 257 / 65535.0::DOUBLE + r.v * 257 / 65535.0::DOUBLE, 0) * 255, 0), 0), 0)::INT
      from moved r join moved n using (g, y, x) where r.b = 3 and n.b = 4 union all
    select 'IMG_' || g || '_RGB_CROPPED', y - 1, (x - 1) * 3 + 3 - b, v::INT from moved where b <= 3 and x between 1 and 6 and y between 1 and 6 union all
    select 'IMG_' || g || '_RGB', y, x * 3 + 3 - b, v::INT from moved where b <= 3 and g in (select g from moved group by g having count(distinct b) filter (where b <= 3) = 3)
    """, "grey").replace("\nselect 'IMG_'", """,
bnd as (select (image_id // 5)::VARCHAR as g, (image_id % 5 + 1)::INT as b, y, x, v from grey),
moved as (select o.g, o.b, o.y, o.x, coalesce(s.v, 0) as v from bnd o left join bnd s on s.g = o.g and s.b = o.b
    and s.x = o.x - (o.b = 2)::INT and s.y = o.y + (o.b = 5)::INT)
select 'IMG_'""", 1)


@query("g10_registration_products", PRODUCTS_SQL)
def _(spark, sf):
    """Band 2 moves one pixel to the right and band 5 one up, so one pixel is cropped all round. Tiles of 5 x 5 pixels, so
    that every image has several."""
    files = stored(_band_files(spark, sf))
    b = F.col("band")
    h = F.array(*[F.lit(v) for v in (1.0, 0.0)], (b == 2).cast("double"), *[F.lit(v) for v in (0.0, 1.0)], -(b == 5).cast("double"),
                *[F.lit(v) for v in (0.0, 0.0, 1.0)])
    homographies = files.select("group_key", "band", h.alias("h"))
    tiles = stored(R.tiles_of_files(files, 5))
    return R.samples_of(R.product_tiles(tiles, homographies, B.crop_box(homographies, WIDTH, HEIGHT), 5))


@query("g19_registered_products", PRODUCTS_SQL)
def _(spark, sf):
    """The same products from descriptors: the vectors of a hundred are the keypoints of the images of the same hundred,
    in every band at the places that its shift gives."""
    files = stored(_band_files(spark, sf))
    k, b = F.col("kp"), F.col("band")
    vectors = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("_of"), F.col("vec_id").alias("kp"), F.col("embedding").alias("desc"))
    seen = files.select("group_key", "band", F.floor(F.col("group_key").cast("long") / 20).alias("_of")).join(vectors, "_of")
    keypoints = seen.select(
        "group_key", "band", "kp", "desc", (k * 37 % 101 - (b == 2).cast("int")).cast("double").alias("x"), (k * 53 % 97 + (b == 5).cast("int")).cast("double").alias("y")
    )
    return R.samples_of(jobs.register_tiles(files, stored(keypoints), WIDTH, HEIGHT, tile=5))
