"""Timelines, job times and host metrics on the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.registry import (
    CPU_METRICS, MEMORY_METRICS, epoch_micros, event_log, metrics, query, sql, table,
)
from furrow.functions.text import metric_seconds, wall_clock
from furrow.operators import telemetry as T
from furrow.operators.ordered import row_index
from furrow.sources.sinks import json_lines


@query("f06_listener_events", sql("select app, event, ts_ms, event_id from kept", "kept"))
def _(spark, sf):
    return T.listener_events(event_log(spark, sf)).select("app", "event", "ts_ms", "event_id")


@query("w02_running_executors", sql("select app, event_id, executors from timeline", "timeline"))
def _(spark, sf):
    return T.executor_timeline(event_log(spark, sf)).select("app", "event_id", "executors")


@query("w03_next_event", sql("select app, event_id, next_event, next_ms from timeline", "timeline"))
def _(spark, sf):
    return T.executor_timeline(event_log(spark, sf)).select("app", "event_id", "next_event", "next_ms")


@query("w04_series_per_app", sql("select app, seg, count(*) as events, max(executors) as peak from timeline group by 1, 2", "timeline"))
def _(spark, sf):
    return T.executor_timeline(event_log(spark, sf)).groupBy("app", "seg").agg(
        F.count("*").alias("events"), F.max("executors").alias("peak")
    )


CLOCK = "strftime(make_timestamp({} * 1000), '%Y-%b-%d %H:%M:%S')"


@query("k08_timeline_record", sql(f"""select app, event, event_id, ts_ms, {CLOCK.format("ts_ms")} as "current_time",
    {CLOCK.format("coalesce(next_ms, ts_ms)")} as next_time, case when next_ms is null then 0 else executors end as executors
    from timeline""", "timeline"))
def _(spark, sf):
    return T.timeline_record(T.executor_timeline(event_log(spark, sf)))


@query("w11_carried_to_end", sql(f"""select app, event, event_id, executors, ts_ms as at_ms from timeline union all
    select app, event, event_id, executors, next_ms from timeline where next_event = '{T.APP_END}'""", "timeline"))
def _(spark, sf):
    return T.carried_to_end(T.executor_timeline(event_log(spark, sf)))


@query("w05_elapsed_seconds", sql("select app, event_id, (ts_ms - (select min(ts_ms) from kept)) / 1000.0::DOUBLE as elapsed from kept", "kept"))
def _(spark, sf):
    events = T.listener_events(event_log(spark, sf))
    return events.select("app", "event_id", T.seconds_since(events, "ts_ms").alias("elapsed"))


@query("w06_last_per_second", sql("""select app, second, executors from (select app, executors,
    floor((ts_ms - (select min(ts_ms) from kept)) / 1000.0::DOUBLE)::BIGINT as second, row_number() over (partition by app,
    floor((ts_ms - (select min(ts_ms) from kept)) / 1000.0::DOUBLE) order by ts_ms desc, event_id desc) as i from timeline) where i = 1""",
    "timeline"))
def _(spark, sf):
    events = event_log(spark, sf)
    start = T.listener_events(events).agg(F.min("ts_ms")).scalar()
    return T.last_per_second(T.executor_timeline(events), start)


@query("w07_filled_timeline", sql("""select app, at_ms // 3600000 as hour, count(*) as seconds, min(at_ms) as first_ms, max(at_ms) as last_ms,
    min(executors) as least, max(executors) as most, sum(executors)::BIGINT as total, sum(executors * (at_ms // 1000 % 3600))::BIGINT as placed,
    sum(event_id)::BIGINT as event_ids from (select app, event_id, executors, unnest(range(ts_ms,
      ts_ms + 1000 * greatest((coalesce(next_ms, ts_ms + 1000) - ts_ms + 999) // 1000, 1), 1000)) as at_ms from timeline) group by 1, 2""", "timeline"))
def _(spark, sf):
    """Every second of every app, opened: a month is some millions of rows for each app. The rows are summed up for each
    hour; ``placed`` weighs the count of a second by its place in the hour."""
    each = T.filled(T.executor_timeline(event_log(spark, sf)))
    place = F.expr("pmod(at_ms, 3600000L) div 1000L")
    return each.groupBy("app", F.expr("(at_ms - pmod(at_ms, 3600000L)) div 3600000L").alias("hour")).agg(
        F.count("*").alias("seconds"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.min("executors").alias("least"),
        F.max("executors").alias("most"), F.sum("executors").alias("total"), F.sum(F.col("executors") * place).alias("placed"),
        F.sum("event_id").alias("event_ids"),
    )


@query("w07_steps_per_day", sql("""select app, day, sum(least(steps, hi) - greatest(0, lo))::BIGINT as seconds, max(executors) as peak
    from (select *, ceil((day * 86400000 - from_ms) / 1000.0::DOUBLE)::BIGINT as lo, ceil(((day + 1) * 86400000 - from_ms) / 1000.0::DOUBLE)::BIGINT as hi
      from (select *, unnest(range(from_ms // 86400000, (from_ms + (steps - 1) * 1000) // 86400000 + 1)) as day
        from (select app, ts_ms as from_ms, executors, greatest((coalesce(next_ms, ts_ms + 1000) - ts_ms + 999) // 1000, 1)::BIGINT as steps
          from timeline where app like 'other%'))) group by 1, 2""", "timeline"))
def _(spark, sf):
    """The seconds of the jobs of one kind, counted for each day."""
    chosen = T.executor_timeline(event_log(spark, sf).where(F.col("app").startswith("other")))
    each = T.steps_per_bin(T.intervals(chosen), 86400000)
    return each.groupBy("app", F.col("bin").alias("day")).agg(F.sum("steps").alias("seconds"), F.max("executors").alias("peak"))


@query("a19_job_times", sql("select *, round(waiting + execution, 3) as total from jobsecs", "jobsecs"))
def _(spark, sf):
    return T.job_times(event_log(spark, sf))


@query("a20_mean_times", sql("select round(avg(waiting), 3) as waiting, round(avg(execution), 3) as execution from jobsecs", "jobsecs"))
def _(spark, sf):
    return T.mean_times(T.job_times(event_log(spark, sf)))


@query("a21_makespan", sql("select (max(end_ms) - min(start_ms)) / 1000.0::DOUBLE as makespan from jobtimes", "jobtimes"))
def _(spark, sf):
    return T.makespan(T.job_times(event_log(spark, sf)))


@query("a22_peak", sql("""select max(executors) as peak_executors, (max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE as longest_elapsed
    from timeline""", "timeline"))
def _(spark, sf):
    return T.peak(T.executor_timeline(event_log(spark, sf)))


JOB_SQL = "case when app like '%imageClustering%' then 'IC' when app like '%flowerCounter%' then 'FC' when app like '%imageRe%' then 'IR' end"


@query("j09_job_marks", sql(f"""select app, {JOB_SQL} as code, start_s, end_s, round((start_s + end_s) / 2.0::DOUBLE)::BIGINT as label_s,
    round(a.value, 6) as start_value, round(b.value, 6) as end_value
    from (select *, round((first_executor_ms - (select min(ts_ms) from ev)) / 1000.0::DOUBLE)::BIGINT as start_s,
      round((end_ms - (select min(ts_ms) from ev)) / 1000.0::DOUBLE)::BIGINT as end_s from jobtimes) j
    left join axis a on a.slot = floor(floor(first_executor_ms / 1000) / 15) * 15
    left join axis b on b.slot = floor(floor(end_ms / 1000) / 15) * 15""", "jobtimes", "mem").replace(
    "\nselect app, case", ",\naxis as (select floor(ts / 15)::BIGINT * 15 as slot, avg(value) as value from mem group by 1)\nselect app, case", 1))
def _(spark, sf):
    marks = T.job_marks(event_log(spark, sf), metrics(spark, sf))
    return marks.withColumns({c: F.round(c, 6) for c in ("start_value", "end_value")})


# Each job from its first executor to its end, and from its start to its first executor, in seconds.
SPANS = """, spans as (select app, floor(first_executor_ms / 1000)::BIGINT as lo, floor(end_ms / 1000)::BIGINT as hi from jobtimes),
    waits as (select app, floor(start_ms / 1000)::BIGINT as lo, floor(first_executor_ms / 1000)::BIGINT as hi from jobtimes)"""


def _spans(spark, sf, start: str, end: str):
    times = T.job_times(event_log(spark, sf))
    second = lambda c: F.floor(F.col(c) / F.lit(1000)).cast("long")
    return times.select("app", second(start).alias("lo"), second(end).alias("hi"))


@query("j09_job_load", sql("", "jobtimes", "mem").rstrip() + SPANS + """ select app, metric, count(value) as rows, round(avg(value), 6) as mean, max(value) as peak
    from spans join mem on ts between lo and hi group by 1, 2""")
def _(spark, sf):
    """Mean and peak of each metric in the time that each job runs."""
    load = T.span_load(_spans(spark, sf, "first_executor_ms", "end_ms"), metrics(spark, sf), ["app"], ["metric"])
    return load.withColumn("mean", F.round("mean", 6))


@query("j09_rows_in_waits", sql("", "jobtimes", "mem").rstrip() + SPANS + """ select app, ts, host, metric, round(value, 6) as value, lo, hi
    from waits join mem on ts between lo and hi""")
def _(spark, sf):
    """Every metric row in the time that a job waits for its first executor."""
    # rounded before they meet the waits: once for each row, not once for each of its waits
    points = metrics(spark, sf).withColumn("value", F.round("value", 6))
    found = T.rows_in_spans(_spans(spark, sf, "start_ms", "first_executor_ms"), points)
    return found.select("app", "ts", "host", "metric", "value", "lo", "hi")


@query("o04_jobs_by_total", sql("select app, round(waiting + execution, 3) as total from jobsecs order by total desc, app", "jobsecs"))
def _(spark, sf):
    return T.job_times(event_log(spark, sf)).select("app", "total").orderBy(F.desc("total"), "app")


@query("k05_sorted_json", sql("""select event_id, '{"app":"' || app || '","event":"' || event || '","event_id":' || event_id || ',"ts_ms":' || ts_ms || '}' as line
    from ev""", "ev"))
def _(spark, sf):
    return json_lines(event_log(spark, sf)).withColumn("event_id", F.get_json_object("line", "$.event_id").cast("bigint"))


@query("p03_local_time", sql(f"select event_id, {CLOCK.format('ts_ms')} as local_time from ev", "ev"))
def _(spark, sf):
    return event_log(spark, sf).select("event_id", wall_clock(F.col("ts_ms")).alias("local_time"))


@query("p04_metric_time", "select event_id, floor(epoch_us(ts) / 1000000)::BIGINT as ts_s from events")
def _(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, sf, "events").select("event_id", metric_seconds(text).alias("ts_s"))


# ---- host metrics -----------------------------------------------------------------


# January 2024, the month of the events.
MONTH = 1704067200, 1706745599

FETCHED = """, inside as (select * from mem where ts between {} and {} and host not in ('h0', 'h7') and value is not null),
    h as (select host, metric, floor(ts / 15)::BIGINT * 15 as ts, avg(value) as value from inside group by 1, 2, 3)""".format(*MONTH)


@query("s11_fetched_runs", sql("", "mem").rstrip() + FETCHED + f""",
    n as (select *, lead(ts) over w as next_ts, lag(ts) over w as before_ts, lead(value) over w as next_value from h window w as (partition by host, metric order by ts))
    select host, metric, ts, round(value, 6) as value, next_ts, round(next_value, 6) as next_value,
      (coalesce(next_ts, {MONTH[1] // 15 * 15 + 15}) - ts) // 15 as slots from n
    union all select host, metric, {MONTH[0]}, null, ts, round(value, 6), (ts - {MONTH[0]}) // 15 from n where before_ts is null and ts > {MONTH[0]}""")
def _(spark, sf):
    """A month at 15 seconds, gaps as runs."""
    runs = T.fetch_runs(metrics(spark, sf), *MONTH, exclude_hosts=["h0", "h7"])
    return runs.withColumns({c: F.round(c, 6) for c in ("value", "next_value")})


@query("s11_fetched_metrics", sql("", "mem").rstrip() + FETCHED + f""",
    ax as (select host, metric, unnest(range({MONTH[0]}, {MONTH[1] + 1}, 15))::BIGINT as ts from (select distinct host, metric from h))
    select host, metric, ts // 3600 * 3600 as hour, count(*) as slots, count(value) as known, round(avg(value), 6) as value
    from ax left join h using (host, metric, ts) group by 1, 2, 3""")
def _(spark, sf):
    """Each slot of 15 seconds of a month, counted and averaged for each hour."""
    fetched = T.fetch(metrics(spark, sf), *MONTH, exclude_hosts=["h0", "h7"])
    hour = (F.floor(F.col("ts") / F.lit(3600)) * 3600).cast("long").alias("hour")
    return fetched.groupBy("host", "metric", hour).agg(
        F.count("*").alias("slots"), F.count("value").alias("known"), F.round(F.avg("value"), 6).alias("value")
    )


@query("f07_picked_metrics", sql("select ts, host, metric, value from mem where metric like '%mem_%' and host not in ('h3', 'h10')", "mem"))
def _(spark, sf):
    return T.pick_metrics(metrics(spark, sf), ["mem_"], ["h3", "h10"])


def slotted(spark, sf, names):
    """Means of each slot of 15 seconds."""
    m = metrics(spark, sf, names)
    return m.groupBy(T.slot(F.col("ts")).alias("ts"), "host", "metric").agg(F.avg("value").alias("value"))


SLOTTED = ", slotted as (select floor(ts / 15)::BIGINT * 15 as ts, host, metric, avg(value) as value from {} group by 1, 2, 3)"


def _slotted_sql(source: str, final: str) -> str:
    return sql("", source).rstrip() + SLOTTED.format(source) + "\n" + final


@query("a14_host_mean", _slotted_sql("cpu", """select ts, metric, round(avg(case when metric like 'bytes%' then value / 1024 else value end), 6) as value,
    count(value) as hosts from slotted group by 1, 2"""))
def _(spark, sf):
    return T.host_mean(slotted(spark, sf, CPU_METRICS)).withColumn("value", F.round("value", 6))


@query("a14_cpu_use", _slotted_sql("cpu", """select ts, round(avg(value) filter (where metric = 'cpu_user')
    + avg(value) filter (where metric = 'cpu_wio'), 6) as cpu_use from slotted group by 1"""))
def _(spark, sf):
    return T.cpu_use(slotted(spark, sf, CPU_METRICS), with_wait=True).withColumn("cpu_use", F.round("cpu_use", 6))


@query("a15_host_sum", _slotted_sql("cpu", "select ts, metric, round(sum(value) / 11, 6) as value from slotted group by 1, 2"))
def _(spark, sf):
    return T.host_sum(slotted(spark, sf, CPU_METRICS), 11.0).withColumn("value", F.round("value", 6))


MEMORY_SQL = """select ts, round(avg(used), 4) as mem_used, round(100 - avg(used), 4) as mem_free from (select ts, host, (t - f) / nullif(t, 0) * 100 as used
    from (select ts, host, sum(value) filter (where metric = 'mem_total') as t, coalesce(sum(value) filter (where metric = 'mem_free'), 0)
      + coalesce(sum(value) filter (where metric = 'mem_cached'), 0) + coalesce(sum(value) filter (where metric = 'mem_buffers'), 0) as f
      from slotted group by 1, 2)) group by 1"""


@query("a16_memory_use", _slotted_sql("mem", MEMORY_SQL))
def _(spark, sf):
    used = T.memory_use(slotted(spark, sf, MEMORY_METRICS))
    return used.select("ts", F.round("mem_used", 4).alias("mem_used"), F.round("mem_free", 4).alias("mem_free"))


@query("a16_memory_by_class", _slotted_sql("mem", """select ts, round(avg(value / case when host like '%h1%' then 40.0 else 25.0 end * 100), 8) as mem_free,
    round(100 - avg(value / case when host like '%h1%' then 40.0 else 25.0 end * 100), 8) as mem_used from slotted where metric = 'mem_free' group by 1"""))
def _(spark, sf):
    used = T.memory_use_by_class(slotted(spark, sf, MEMORY_METRICS), ["h1"], 40.0, 25.0)
    return used.select("ts", F.round("mem_free", 8).alias("mem_free"), F.round("mem_used", 8).alias("mem_used"))


@query("a17_map_means", """select floor(epoch_us(ts) / 1000000)::BIGINT as ts, 'k' as name,
    round(avg((props->>'k')::DOUBLE), 6) as value, count(*) as n from events group by 1""")
def _(spark, sf):
    """Mean of every key of the maps at every timestamp."""
    e = table(spark, sf, "events")
    rows = e.select(F.floor(epoch_micros(F.col("ts")) / F.lit(1000000)).cast("long").alias("ts"), F.from_json("props", "map<string,double>").alias("props"))
    return T.map_means(rows, "ts", "props").withColumn("value", F.round("value", 6))


@query("x19_flat_json", """select event_id, 'k' as path, props->>'k' as value from events union all
    select event_id, 'tags_0', event_type from events union all select event_id, 'tags_1_user', user_id::VARCHAR from events
    union all select event_id, 'tags_1_none', null from events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    tags = F.concat(
        F.lit(', "tags": ["'), "event_type", F.lit('", {"user": '), F.col("user_id").cast("string"), F.lit(', "none": null}]}')
    )
    nested = e.select("event_id", F.concat(F.expr("substring(props, 1, length(props) - 1)"), tags).alias("doc"))
    return T.flat_json(nested, "event_id", "doc")


@query("a18_iteration_means", """select i as iteration, round(avg(l_quantity), 6) as mean, count(*) as runs from (select l_quantity,
    (row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1)::BIGINT as i from lineitem) group by 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return T.iteration_means(li, "l_suppkey", order, "l_quantity").withColumn("mean", F.round("mean", 6))


@query("a23_standard_error", "select event_type, round(stddev_pop(value) / sqrt(count(value)), 6) as std_error from events group by 1")
def _(spark, sf):
    return T.standard_error(table(spark, sf, "events"), ["event_type"], "value").withColumn("std_error", F.round("std_error", 6))


@query("a24_unit_histogram", """select bin::BIGINT as bin, coalesce(n, 0) as n from (select unnest(range((select floor(max(value))::BIGINT + 1 from events))) as bin)
    left join (select floor(value)::BIGINT as bin, count(*) as n from events where value >= 0 group by 1) using (bin)""")
def _(spark, sf):
    return T.unit_histogram(table(spark, sf, "events"), "value")


@query("a24_equal_histogram", """select bin::BIGINT as bin, coalesce(n, 0) as n from (select unnest(range(10)) as bin) left join
    (select least(floor((v - lo) * 10 / nullif(hi - lo, 0)::DOUBLE), 9)::BIGINT as bin, count(*) as n from
    (select trunc(value)::BIGINT as v from events), (select min(trunc(value))::BIGINT as lo, max(trunc(value))::BIGINT as hi from events) group by 1) using (bin)""")
def _(spark, sf):
    return T.equal_histogram(table(spark, sf, "events"), "value")


@query("w08_interpolated", sql("", "mem").rstrip() + """, h as (select host, metric, floor(ts / 15)::BIGINT * 15 as ts, avg(value) as value
      from mem where value is not null group by 1, 2, 3),
    ax as (select host, metric, unnest(range((select floor(min(ts) / 15)::BIGINT * 15 from mem), (select max(ts) + 1 from mem), 15))::BIGINT as ts
      from (select distinct host, metric from h)),
    s as (select a.*, h.value from ax a left join h using (host, metric, ts)),
    lo as (select s.*, h.ts as lt, h.value as lv from s asof left join h on s.host = h.host and s.metric = h.metric and s.ts >= h.ts),
    f as (select lo.*, h.ts as rt, h.value as rv from lo asof left join h on lo.host = h.host and lo.metric = h.metric and lo.ts <= h.ts)
    select host, metric, ts // 3600 * 3600 as hour, count(*) as slots, round(min(v) + 1e-9, 6) as least, round(max(v) + 1e-9, 6) as greatest, round(avg(v) + 1e-9, 6) as mean
    from (select host, metric, ts, case when value is not null then value when lv is null then rv when rv is null then lv
      else lv + (rv - lv) * ((ts - lt) // 15) / ((rt - lt) // 15) end as v from f) group by 1, 2, 3""")
def _(spark, sf):
    """The whole month at 15 seconds, gaps filled, summed up for each hour. Many values end in a 5 behind the digits
    shown; a little is added, so that the last bit does not decide how these are rounded."""
    near = lambda c: F.round(c + 1e-9, 6)
    series = T.interpolated_axis(metrics(spark, sf))
    hour = (F.floor(F.col("ts") / F.lit(3600)) * 3600).cast("long").alias("hour")
    return series.groupBy("host", "metric", hour).agg(
        F.count("*").alias("slots"), near(F.min("filled")).alias("least"), near(F.max("filled")).alias("greatest"),
        near(F.avg("filled")).alias("mean"),
    )


@query("w09_empirical_cdf", _slotted_sql("cpu", """select ts, metric, round(value, 6) as value, round((row_number() over (partition by metric order by value, ts) - 1)
    / nullif(count(*) over (partition by metric) - 1, 0)::DOUBLE, 6) as cdf from (select ts, metric, round(avg(value), 9) as value from slotted group by 1, 2)"""))
def _(spark, sf):
    mean = T.host_mean(slotted(spark, sf, {**CPU_METRICS, "error": "net_in"})).select("ts", "metric", F.round("value", 9).alias("value"))
    renamed = mean.withColumn("metric", F.when(F.col("metric") == "net_in", "bytes_in").otherwise(F.col("metric")))
    out = T.empirical_cdf(renamed, ["metric"], "value", ["ts"])
    return out.select("ts", "metric", F.round("value", 6).alias("value"), F.round("cdf", 6).alias("cdf"))


ERF = """(sign(u) * (1 - (((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t
    + 0.254829592::DOUBLE) * t) * exp(-u * u)))"""


@query("w10_normal_curve", f"""select event_id, round((1 + {ERF}) * 0.5, 6) as cdf, round(exp(-z * z / 2) / (s * sqrt(2 * pi())), 6) as pdf
    from (select *, z / sqrt(2.0::DOUBLE) as u, 1 / (1 + abs(z / sqrt(2.0::DOUBLE)) * 0.3275911::DOUBLE) as t from (select event_id, (value - m) / s as z, s
      from events join (select event_type, avg(value) as m, stddev_pop(value) as s from events group by 1) using (event_type)))""")
def _(spark, sf):
    curve = T.normal_curve(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return curve.select("event_id", F.round("cdf", 6).alias("cdf"), F.round("pdf", 6).alias("pdf"))


@query("u02_halves", """select page_id, case when row_number() over (order by url, page_id) <= count(*) over () // 2 then 'first' else 'second' end as half from pages""")
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    half = F.floor(pages.agg(F.count("*")).scalar() / 2)
    indexed = row_index(pages, "url", "page_id")
    return indexed.select("page_id", F.when(F.col("row_index") < half, "first").otherwise("second").alias("half"))


@query("a25_partition_sizes", "select count(*) as rows, count(*) / 8.0::DOUBLE as mean, 8::BIGINT as partitions from events")
def _(spark, sf):
    """Sizes that repartitioning by key gives depend on Spark's hash; their sum, mean and number do not."""
    sizes = T.partition_sizes(table(spark, sf, "events").repartition(8, "event_id"))
    return sizes.select((F.col("mean") * F.col("partitions")).cast("long").alias("rows"), "mean", "partitions")


@query("a28_key_sums", "select event_type as key, round(sum(value), 4) as total from events group by 1")
def _(spark, sf):
    entries = table(spark, sf, "events").select(F.col("event_type").alias("key"), "value")
    return T.key_sums(entries).withColumn("total", F.round("total", 4))


@query("a28_key_lists", "select event_id, event_type as key, value, row_number() over (partition by event_type order by event_id) as pos from events")
def _(spark, sf):
    entries = table(spark, sf, "events").select("event_id", F.col("event_type").alias("key"), "value")
    return T.key_lists(entries, ["event_id"])


@query("o06_layout", "select event_type, count(*) as n from events group by 1")
def _(spark, sf):
    spread = table(spark, sf, "events").repartition(8, "event_id")
    return spread.coalesce(4).groupBy("event_type").agg(F.count("*").alias("n"))


RESULT_SQL = """with r as (select l_returnflag as experiment, l_linestatus as manager, 'c' || (l_linenumber % 3) as config, l_quantity as seconds from lineitem),
    w as (select experiment, manager, avg(seconds) filter (where config = 'c0') as c0, avg(seconds) filter (where config = 'c1') as c1,
      avg(seconds) filter (where config = 'c2') as c2 from r group by 1, 2)"""


@query("a29_compared_results", RESULT_SQL + """ select experiment, manager, config, round(s, 6) as seconds, round(c0 - s, 6) as saved, round(c0 / s, 6) as speed_up
    from (select experiment, manager, c0, 'c1' as config, c1 as s from w union all select experiment, manager, c0, 'c2', c2 from w)""")
def _(spark, sf):
    results = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("experiment"), F.col("l_linestatus").alias("manager"),
        F.concat(F.lit("c"), (F.col("l_linenumber") % 3).cast("string")).alias("config"), F.col("l_quantity").alias("seconds"),
    )
    out = T.compare_results(results, ["c0", "c1", "c2"], "c0")
    return out.withColumns({c: F.round(c, 6) for c in ("seconds", "saved", "speed_up")})
