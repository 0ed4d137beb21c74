"""Query registration and the table views that stand in for images, logs and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.telemetry import APP_END, APP_START, EXECUTOR_ADDED, EXECUTOR_REMOVED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- views ------------------------------------------------------------------------

WIDTH = HEIGHT = 8
CORNERS = [(1, 1), (7, 1), (1, 7), (7, 7)]

EVENT_NAMES = {
    "signup": APP_START, "purchase": EXECUTOR_ADDED, "error": EXECUTOR_REMOVED, "view": APP_END, "click": "SparkListenerJobStart",
}
APP_PREFIXES = ["imageClustering_", "flowerCounter_", "imageRegistration_", "other_"]
MEMORY_METRICS = {
    "signup": "mem_total", "purchase": "mem_free", "error": "mem_cached", "view": "mem_buffers", "click": "cpu_user",
}
CPU_METRICS = {
    "signup": "cpu_user", "purchase": "cpu_wio", "error": "bytes_in", "view": "load_one", "click": "cpu_idle",
}


def epoch_micros(ts: Column) -> Column:
    """Micros of a zone-less timestamp, read as UTC whatever the session zone is."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def mapped(column: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in names.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def mapped_sql(column: str, names: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + " end"


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 grey images."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("e"))
    low, high = e.agg(F.min(F.array_min("e"))).scalar(), e.agg(F.max(F.array_max("e"))).scalar()
    pixel = e.select("image_id", F.posexplode("e").alias("pos", "e"))
    return pixel.select(
        "image_id",
        F.floor(F.col("pos") / F.lit(WIDTH)).cast("int").alias("y"),
        (F.col("pos") % F.lit(WIDTH)).alias("x"),
        F.floor((F.col("e") - low) / (high - low) * F.lit(255)).cast("int").alias("v"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.array(*[F.lit(p) for p in APP_PREFIXES])
    return table(spark, sf_dir, "events").select(
        F.concat(F.get(prefix, (F.col("user_id") % 4).cast("int")), F.col("user_id").cast("string")).alias("app"),
        mapped(F.col("event_type"), EVENT_NAMES).alias("event"),
        F.floor(epoch_micros(F.col("ts")) / F.lit(1000)).cast("long").alias("ts_ms"),
        "event_id",
    )


def metrics(spark: SparkSession, sf_dir: str, names: dict[str, str] | None = None) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.floor(epoch_micros(F.col("ts")) / F.lit(1000000)).cast("long").alias("ts"),
        F.concat(F.lit("h"), (F.col("user_id") % 11).cast("string")).alias("host"),
        mapped(F.col("event_type"), names or MEMORY_METRICS).alias("metric"),
        "value",
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per order and line number; the lines above 5 are members that no band column holds."""
    name = F.concat(F.lit("IMG_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".png"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))
        .select(
            F.col("l_orderkey").cast("string").alias("group_key"), F.col("l_linenumber").alias("band"), name.alias("name"),
            F.lit(0).alias("y"), F.lit(0).alias("x"), "v",
        )
    )


def homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mild transform per (order, line), from its average prices and rates."""
    mean = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.round(F.avg("l_discount"), 6).alias("d"), F.round(F.avg("l_tax"), 6).alias("t"),
        F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_extendedprice"), 6).alias("p"),
    )
    d, t, q, p = (F.col(c) for c in "dtqp")
    h = F.array(d + 1, -t, q, t, d + 1, p / 1000.0, d / 1000.0, t / 1000.0, F.lit(1.0))
    return mean.select(F.col("l_orderkey").cast("string").alias("group_key"), F.col("l_linenumber").alias("band"), h.alias("h"))


# Vectors of a group, each half of it a band's keypoints: matching compares within groups, so its work grows with the table.
GROUP = 100


def keyed_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``GROUP`` neighbouring vectors; the label, one of four here, is the band."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("g"), F.floor(F.col("vec_id") / GROUP).cast("string")).alias("group_key"), (F.col("label") % 4).alias("band"),
        F.col("vec_id").alias("kp"), F.col("embedding").alias("desc"),
        (F.col("vec_id") % 8).cast("double").alias("x"), F.floor(F.col("vec_id") / 8).cast("double").alias("y"),
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label as image, vector as keypoint."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("kp"), F.col("embedding").alias("desc")
    )


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of the labels with the same remainder by 3, rounded."""
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("cluster"), F.posexplode("embedding").alias("pos", "e"))
    mean = e.groupBy("cluster", "pos").agg(F.round(F.avg(F.col("e").cast("double")), 6).alias("m"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return mean.groupBy("cluster").agg(F.transform(packed, lambda s: s["m"]).alias("center"))


def inside_sql(corners=CORNERS, width: int = WIDTH, height: int = HEIGHT) -> str:
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = corners
    xs, ys = [ax, bx, cx, dx], [ay, by, cy, dy]

    def turn(px, py, qx, qy):
        return f"(({qx} - {px}) * (y - {qy}) - ({qy} - {py}) * (x - {qx}))"

    return (
        f"x >= {max(min(xs), 0)} and x < {min(max(xs), width)} and y >= {max(min(ys), 0)} and y < {min(max(ys), height)} "
        f"and {turn(cx, cy, ax, ay)} > 0 and {turn(dx, dy, bx, by)} < 0 "
        f"and {turn(ax, ay, bx, by)} > 0 and {turn(cx, cy, dx, dy)} < 0"
    )


VIEWS = {
    "px": "select vec_id as image_id, unnest(embedding)::DOUBLE as e, unnest(range(len(embedding))) as pos from embeddings",
    "lim": "select min(e) as lo, max(e) as hi from px",
    "grey": """select image_id, (pos // 8)::INT as y, (pos % 8)::INT as x,
        floor((e - lo) / (hi - lo) * 255)::INT as v from px, lim""",
    "masked": f"select * from grey where {inside_sql()}",
    "hist": "select image_id, v as bin, count(*) as n from masked group by 1, 2",
    "ref": "select bin, n from hist where image_id = (select min(image_id) from hist)",
    "tot": "select bin, sum(n)::BIGINT as n from hist group by 1",
    "corr": "select h.image_id, h.bin - r.bin + 255 as k, sum(h.n * r.n) as c from hist h, ref r group by 1, 2",
    "lagged": """select image_id, k as lag from (select *, row_number() over (partition by image_id order by c desc, k) as i from corr)
        where i = 1""",
    "refcorr": "select r.bin - t.bin + 255 as k, sum(r.n * t.n) as c from ref r, tot t group by 1",
    "reflag": "select k as ref_lag from refcorr order by c desc, k limit 1",
    "shifted": """select image_id, case when image_id = (select min(image_id) from hist) then 0 else lag end as lag, ref_lag,
        ((case when image_id = (select min(image_id) from hist) then 0 else lag end) + ref_lag) % 256 as shift from lagged, reflag""",
    "score": "select image_id, max(n) / sum(n) as score from hist group by 1",
    "yellow": """select s.image_id, s.shift, coalesce(sum(h.n) filter (where h.bin >= (155 + s.shift) % 256), 0)::BIGINT as n_yellow
        from shifted s join hist h using (image_id) group by 1, 2""",
    "sound": "select y.* from yellow y join score c using (image_id) where c.score < 0.2",
    "ev": f"""select (case user_id % 4 when 0 then '{APP_PREFIXES[0]}' when 1 then '{APP_PREFIXES[1]}' when 2 then '{APP_PREFIXES[2]}'
        else '{APP_PREFIXES[3]}' end) || user_id as app, {mapped_sql("event_type", EVENT_NAMES)} as event,
        (epoch_us(ts) // 1000)::BIGINT as ts_ms, event_id from events""",
    "kept": f"select * from ev where event in ('{APP_START}', '{EXECUTOR_ADDED}', '{EXECUTOR_REMOVED}', '{APP_END}')",
    "segs": f"""select *, sum(case when event in ('{APP_START}', '{APP_END}') then 1 else 0 end)
        over (partition by app order by ts_ms, event_id rows unbounded preceding) as seg from kept""",
    "timeline": f"""select app, event, ts_ms, event_id, seg::BIGINT as seg,
        (sum(case event when '{EXECUTOR_ADDED}' then 1 when '{EXECUTOR_REMOVED}' then -1 else 0 end)
          over (partition by app, seg order by ts_ms, event_id rows unbounded preceding))::BIGINT as executors,
        lead(event) over (partition by app order by ts_ms, event_id) as next_event,
        lead(ts_ms) over (partition by app order by ts_ms, event_id) as next_ms from segs""",
    "mem": f"""select floor(epoch_us(ts) / 1000000)::BIGINT as ts, 'h' || (user_id % 11) as host,
        {mapped_sql("event_type", MEMORY_METRICS)} as metric, value from events""",
    "cpu": f"""select floor(epoch_us(ts) / 1000000)::BIGINT as ts, 'h' || (user_id % 11) as host,
        {mapped_sql("event_type", CPU_METRICS)} as metric, value from events""",
    "jobtimes": f"""select app, min(ts_ms) filter (where event = '{APP_START}') as start_ms,
        min(ts_ms) filter (where event = '{EXECUTOR_ADDED}') as first_executor_ms,
        max(ts_ms) filter (where event = '{APP_END}') as end_ms from ev group by 1""",
    "jobsecs": """select *, round((first_executor_ms - start_ms) / 1000.0::DOUBLE, 3) as waiting,
        round((end_ms - first_executor_ms) / 1000.0::DOUBLE, 3) as execution from jobtimes""",
    "bands": """select l_orderkey::VARCHAR as group_key, l_linenumber as band, 'IMG_' || l_orderkey || '_' || l_linenumber || '.png' as name,
        0 as y, 0 as x, round(avg(l_extendedprice), 4) as v from lineitem group by l_orderkey, l_linenumber""",
    "wide": """select group_key, y, x, max(v) filter (where band = 1) as b1, max(v) filter (where band = 2) as b2,
        max(v) filter (where band = 3) as b3, max(v) filter (where band = 4) as b4, max(v) filter (where band = 5) as b5,
        count(*) - count(distinct band) filter (where band <= 5) as set_aside from bands group by 1, 2, 3""",
    "rates": """select l_orderkey::VARCHAR as group_key, l_linenumber as band, round(avg(l_discount), 6) as d, round(avg(l_tax), 6) as t,
        round(avg(l_quantity), 6) as q, round(avg(l_extendedprice), 6) as p from lineitem group by 1, 2""",
    "hom": """select group_key, band, d + 1 as h0, -t as h1, q as h2, t as h3, d + 1 as h4, p / 1000.0::DOUBLE as h5,
        d / 1000.0::DOUBLE as h6, t / 1000.0::DOUBLE as h7, 1.0::DOUBLE as h8 from rates""",
    "cen": """select cluster, pos, round(avg(e), 6) as m from (select label % 3 as cluster, unnest(embedding)::DOUBLE as e,
        unnest(range(len(embedding))) as pos from embeddings) group by 1, 2""",
    "dpx": """select vec_id as kp, label, unnest(embedding)::DOUBLE as e, unnest(range(len(embedding))) as pos from embeddings""",
    "cdist": """select kp, any_value(label) as label, cluster, sqrt(sum((e - m) * (e - m))) as dist from dpx join cen using (pos)
        group by kp, cluster""",
    "near1": """select * exclude (i) from (select *, row_number() over (partition by kp order by dist, cluster) as i from cdist) where i = 1""",
    "pair": f"""select a.kp, any_value(a.label % 4) as band, b.kp as target_kp, sqrt(sum((a.e - b.e) * (a.e - b.e))) as dist
        from dpx a join dpx b on a.pos = b.pos and a.kp // {GROUP} = b.kp // {GROUP} and a.label % 4 <> 0 and b.label % 4 = 0 group by a.kp, b.kp""",
    "near2": """select * from (select *, row_number() over (partition by kp order by dist, target_kp) as rank from pair) where rank <= 2""",
    "ratio": """select kp, any_value(band) as band, max(target_kp) filter (where rank = 1) as target_kp,
        max(dist) filter (where rank = 1) as dist, max(dist) filter (where rank = 2) as dist_2 from near2 group by kp
        having max(dist) filter (where rank = 1) < max(dist) filter (where rank = 2) * 0.95::DOUBLE""",
}
NEEDS = {
    "lim": "px", "grey": "lim", "masked": "grey", "hist": "masked", "ref": "hist", "tot": "hist", "corr": "ref", "lagged": "corr",
    "refcorr": "ref tot", "reflag": "refcorr", "shifted": "lagged reflag", "score": "hist", "yellow": "shifted", "sound": "yellow score",
    "kept": "ev", "segs": "kept", "timeline": "segs", "jobtimes": "ev", "jobsecs": "jobtimes", "wide": "bands", "hom": "rates",
    "cdist": "dpx cen", "near1": "cdist", "pair": "dpx", "near2": "pair", "ratio": "near2",
}


def sql(final: str, *views: str) -> str:
    """``WITH`` the named views (and what they need) in front of a statement."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, "").split():
            add(need)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    if not order:
        return final
    return "with " + ",\n".join(f"{v} as ({VIEWS[v]})" for v in order) + "\n" + final
