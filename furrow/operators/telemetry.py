"""Event logs, task metrics and host metrics.

Event table: ``app, event, ts_ms BIGINT, event_id``. Metric table: ``ts BIGINT`` (epoch
seconds), ``host, metric, value``. Ordering is always (time, id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.stats import normal_cdf, normal_pdf
from furrow.functions.text import bytes_to_kb, job_code, wall_clock, whole_seconds
from furrow.operators.ordered import SLICE, across, inside, null_safe_join, rank_within, sliced
from furrow.session import broadcast_if_small, dealt, default_slices, materialize

# The four listener events that make up an executor timeline.
APP_START = "SparkListenerApplicationStart"
EXECUTOR_ADDED = "SparkListenerExecutorAdded"
EXECUTOR_REMOVED = "SparkListenerExecutorRemoved"
APP_END = "SparkListenerApplicationEnd"
LISTENER_EVENTS = (APP_START, EXECUTOR_ADDED, EXECUTOR_REMOVED, APP_END)
# Metric resolution in seconds and the folder left out beside named hosts.
RESOLUTION = 15
# Rule for the stages worth a closer look.
FEW_STAGES, TOP_FEW, TOP_MANY = 20, 1, 7

ORDER = ["ts_ms", "event_id"]


def listener_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin(*LISTENER_EVENTS))


def executor_timeline(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Executors after each event, the segment (runs between start / end events) and the
    next event of the same app.

    The count resets to 0 at start and end, so it equals the running sum of the changes
    minus that sum at the latest reset. For an app that is cut into slices, the first and
    last row of a slice hold all that its other slices need.
    """
    kept = sliced(listener_events(events).select("app", "event", "ts_ms", "event_id"), ["app"], ORDER, slices)
    resets = F.col("event").isin(APP_START, APP_END)
    change = (
        F.when(F.col("event") == EXECUTOR_ADDED, 1).when(F.col("event") == EXECUTOR_REMOVED, -1).otherwise(0).cast("long")
    )
    here = inside(["app"], ORDER)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    local = kept.withColumns(
        {
            "_sum": F.sum(change).over(upto),
            "_seg": F.sum(resets.cast("long")).over(upto),
            "_place": F.row_number().over(here),
            "_event": F.lead("event").over(here),
            "_ms": F.lead("ts_ms").over(here),
        }
    ).withColumn("_base", F.last(F.when(resets, F.col("_sum")), ignorenulls=True).over(upto))
    zero = F.lit(0).cast("long")
    first, last = F.col("_place") == 1, F.col("_ms").isNull()
    edges = local.where(first | last).groupBy("app", SLICE).agg(
        *[F.max(F.when(last, F.col(c))).alias(f"{c}_end") for c in ("_sum", "_seg", "_base")],
        F.max(F.when(first, F.col("event"))).alias("_event_head"),
        F.max(F.when(first, F.col("ts_ms"))).alias("_ms_head"),
    )
    before = across(["app"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumns(
        {
            "_sum0": F.coalesce(F.sum("_sum_end").over(before), zero),
            "_seg0": F.coalesce(F.sum("_seg_end").over(before), zero),
            "_event_later": F.lead("_event_head").over(across(["app"])),
            "_ms_later": F.lead("_ms_head").over(across(["app"])),
        }
    ).withColumn("_base0", F.coalesce(F.last(F.col("_sum0") + F.col("_base_end"), ignorenulls=True).over(before), zero))
    carried = carried.select("app", SLICE, "_sum0", "_seg0", "_base0", "_event_later", "_ms_later")
    joined = null_safe_join(local, carried, ["app", SLICE])
    base = F.coalesce(F.col("_sum0") + F.col("_base"), F.col("_base0"))
    return joined.select(
        "app", "event", "ts_ms", "event_id",
        (F.col("_seg0") + F.col("_seg")).alias("seg"),
        (F.col("_sum0") + F.col("_sum") - base).alias("executors"),
        F.coalesce("_event", "_event_later").alias("next_event"),
        F.coalesce("_ms", "_ms_later").alias("next_ms"),
    )


def timeline_record(timeline: DataFrame) -> DataFrame:
    """Printable record: event, stamp, current and next time, executors. The last event
    of an app has no successor and shows its own time with 0 executors."""
    last = F.col("next_ms").isNull()
    return timeline.select(
        "app", "event", "event_id", "ts_ms",
        wall_clock(F.col("ts_ms")).alias("current_time"),
        wall_clock(F.coalesce("next_ms", "ts_ms")).alias("next_time"),
        F.when(last, F.lit(0).cast("long")).otherwise(F.col("executors")).alias("executors"),
    )


def carried_to_end(timeline: DataFrame) -> DataFrame:
    """Timeline points, with the count before an app end repeated at the end's time."""
    at = F.when(F.col("next_event") == APP_END, F.array("ts_ms", "next_ms")).otherwise(F.array("ts_ms"))
    return timeline.select("app", "event", "event_id", "executors", F.explode(at).alias("at_ms"))


def seconds_since(df: DataFrame, column: str, start: Column | None = None) -> Column:
    """Seconds since the first value of an epoch-ms column (or a given start)."""
    origin = df.agg(F.min(column)).scalar() if start is None else start
    return (F.col(column) - origin) / F.lit(1000.0)


def last_per_second(timeline: DataFrame, start: Column | None = None) -> DataFrame:
    """Last count of every second of each app, on the axis of the experiment start."""
    second = F.floor(seconds_since(timeline, "ts_ms", start)).cast("long")
    return timeline.groupBy("app", second.alias("second")).agg(
        F.max_by("executors", F.struct("ts_ms", "event_id")).alias("executors")
    )


def counted_out(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row ``count`` times, with ``name`` = 0, 1, ... Opened in two levels (runs of 4096, then their members),
    so that no row ever carries one long array; runs are spread over all tasks in between."""
    run = 4096
    last_run = F.floor((F.col(count) - 1) / run)
    runs = rows.where(F.col(count) > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), last_run)))
    last = F.least(F.col(count) - 1, F.col("_run") * run + (run - 1))
    return runs.withColumn(name, F.explode(F.sequence(F.col("_run") * run, last))).drop("_run")


def intervals(timeline: DataFrame, step_s: int = 1) -> DataFrame:
    """``app, event_id, from_ms, to_ms, steps, executors``: the time from each event to the next one, with the count
    that holds in it and the number of steps it has. An app's last event holds for one step, and so does an event that
    the next one follows within the same step."""
    step = step_s * 1000
    to = F.coalesce("next_ms", F.col("ts_ms") + step)
    # steps that begin before the end, in whole numbers
    spans = timeline.select("app", "event_id", F.col("ts_ms").alias("from_ms"), to.alias("to_ms"), "executors")
    steps = F.greatest(F.expr(f"(to_ms - from_ms + {step - 1}) div {step}"), F.lit(1).cast("long"))
    return spans.select("app", "event_id", "from_ms", "to_ms", steps.alias("steps"), "executors")


def opened_steps(spans: DataFrame, step_s: int = 1) -> DataFrame:
    """One row for each step of the intervals: ``app, event_id, at_ms, executors``. The rows are made where they are
    read; filters on app or time belong before this call."""
    # a few rows of intervals are many steps, and adaptive execution would leave them in few tasks
    steps = counted_out(spans.repartition(default_slices(spans)), "steps", "_k")
    return steps.select("app", "event_id", (F.col("from_ms") + F.col("_k") * (step_s * 1000)).alias("at_ms"), "executors")


def steps_per_bin(spans: DataFrame, bin_ms: int, step_s: int = 1) -> DataFrame:
    """``app, event_id, bin, steps, executors``: how many steps of each interval begin in each bin of ``bin_ms``, the bin
    that starts at 0 being number 0. One row for each interval and bin that has any: steps are counted from where a bin
    cuts the interval, so the work does not depend on how short a step is. An interval without a time is in no bin (NULL)."""
    step, width = step_s * 1000, F.lit(bin_ms)
    bin_of = lambda at: F.floor(at / width).cast("long")
    first, last = bin_of(F.col("from_ms")), bin_of(F.col("from_ms") + (F.col("steps") - 1) * step)
    cut = counted_out(spans.withColumns({"_first": first, "_bins": F.coalesce(last - first + 1, F.lit(1).cast("long"))}), "_bins", "_k")
    cut = cut.withColumn("bin", F.col("_first") + F.col("_k"))
    # number of the first step at or after the start of this bin, and of the next one; NULL is left out of least and greatest
    before = F.expr(f"(greatest(bin * {bin_ms}L - from_ms, 0L) + {step - 1}) div {step}")
    upto = F.expr(f"((bin + 1) * {bin_ms}L - from_ms + {step - 1}) div {step}")
    steps = F.least("steps", upto) - F.when(F.col("bin").isNull(), 0).otherwise(before)
    return cut.select("app", "event_id", "bin", steps.alias("steps"), "executors").where("steps > 0")


def filled(timeline: DataFrame, step_s: int = 1) -> DataFrame:
    """One row per step between an event and the next one, with the current count."""
    return opened_steps(intervals(timeline, step_s), step_s)


def job_times(events: DataFrame) -> DataFrame:
    """Start, first executor, end, and waiting / execution / total seconds per app."""

    def at(name: str) -> Column:
        return F.when(F.col("event") == name, F.col("ts_ms"))

    spans = events.groupBy("app").agg(
        F.min(at(APP_START)).alias("start_ms"),
        F.min(at(EXECUTOR_ADDED)).alias("first_executor_ms"),
        F.max(at(APP_END)).alias("end_ms"),
    )
    seconds = F.lit(1000.0)
    return spans.withColumns(
        {
            "waiting": F.round((F.col("first_executor_ms") - F.col("start_ms")) / seconds, 3),
            "execution": F.round((F.col("end_ms") - F.col("first_executor_ms")) / seconds, 3),
        }
    ).withColumn("total", F.round(F.col("waiting") + F.col("execution"), 3))


def mean_times(times: DataFrame) -> DataFrame:
    return times.agg(F.round(F.avg("waiting"), 3).alias("waiting"), F.round(F.avg("execution"), 3).alias("execution"))


def makespan(times: DataFrame) -> DataFrame:
    return times.agg(((F.max("end_ms") - F.min("start_ms")) / F.lit(1000.0)).alias("makespan"))


def peak(timeline: DataFrame) -> DataFrame:
    """Most executors of any app, and the latest event on the common axis."""
    return timeline.agg(
        F.max("executors").alias("peak_executors"),
        ((F.max("ts_ms") - F.min("ts_ms")) / F.lit(1000.0)).alias("longest_elapsed"),
    )


def job_marks(events: DataFrame, metrics: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """Start, end and label position of each job on the metric axis, with the mean metric
    value of the slots it starts and ends in (equi joins on the slot)."""
    origin = events.agg(F.min("ts_ms")).scalar()
    spans = job_times(events).select(
        "app",
        job_code(F.col("app")).alias("code"),
        F.round((F.col("first_executor_ms") - origin) / F.lit(1000.0)).cast("long").alias("start_s"),
        F.round((F.col("end_ms") - origin) / F.lit(1000.0)).cast("long").alias("end_s"),
        slot(F.floor(F.col("first_executor_ms") / 1000), resolution).alias("start_slot"),
        slot(F.floor(F.col("end_ms") / 1000), resolution).alias("end_slot"),
    )
    axis = metrics.groupBy(slot(F.col("ts"), resolution).alias("slot")).agg(F.avg("value").alias("value"))
    at_start = axis.select(F.col("slot").alias("start_slot"), F.col("value").alias("start_value"))
    at_end = axis.select(F.col("slot").alias("end_slot"), F.col("value").alias("end_value"))
    return (
        spans.withColumn("label_s", F.round((F.col("start_s") + F.col("end_s")) / F.lit(2.0)).cast("long"))
        .join(at_start, "start_slot", "left")
        .join(at_end, "end_slot", "left")
        .select("app", "code", "start_s", "end_s", "label_s", "start_value", "end_value")
    )


def span_load(spans: DataFrame, points: DataFrame, names: Sequence[str], by: Sequence[str] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """``names, by, rows, mean, peak`` of the values whose time lies in a span ``lo`` to ``hi``, both included.

    No row meets a span. Values are summed up for dyadic ranges of time, which are as many as bits of the whole range
    for each second; a span of any length is at most two ranges of each size, taken from its ends inwards. Both sides
    meet by equal ranges, and the sums of a span's ranges are added up. Spans that are null or end before they start hold
    nothing, and spans without a value are not returned; spans of equal names are one.
    """
    known = points.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    bounds = known.agg(F.min(ts).alias("low"), F.max(ts).alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    one = F.lit(1).cast("long")
    # at level l a range holds 2 ** l seconds, counted from the first value
    levels = F.sequence(F.lit(0), F.floor(F.log2((high - low + 1).cast("double"))).cast("int"))
    parts = [F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.max("_max").alias("_max")]
    seconds = known.groupBy(F.col(ts).alias("_at"), *by).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.max(value).alias("_max"))
    ranges = (
        seconds.withColumn("_level", F.explode(levels))
        .groupBy("_level", _shifted(F.col("_at") - low, "_level").alias("_node"), *by)
        .agg(*parts)
    )
    # a span from a up to b has the whole ranges ceil(a / 2 ** l) up to floor(b / 2 ** l) at level l; an odd first one and
    # an even last one are in no range of the next level that lies in the span
    cut = spans.where(F.col("lo") <= F.col("hi")).select(*names, (F.greatest("lo", low) - low).alias("_a"), (F.least("hi", high) - low + 1).alias("_b")).where("_a < _b")
    whole = cut.withColumn("_level", F.explode(levels)).select(
        *names, "_level", _shifted(F.col("_a") + _left(one, "_level") - 1, "_level").alias("_a"), _shifted(F.col("_b"), "_level").alias("_b")
    )
    own = F.array(F.when(F.col("_a") % 2 == 1, F.col("_a")), F.when(F.col("_b") % 2 == 1, F.col("_b") - 1))
    covers = whole.where("_a < _b").select(*names, "_level", F.explode(F.array_compact(own)).alias("_node")).distinct()
    found = covers.join(ranges, ["_level", "_node"]).groupBy(*names, *by).agg(*parts)
    return found.select(*names, *by, F.col("_n").alias("rows"), (F.col("_sum") / F.col("_n")).alias("mean"), F.col("_max").alias("peak"))


def _shifted(number: Column, bits: str) -> Column:
    """``floor(number / 2 ** bits)``"""
    return F.call_function("shiftright", number, F.col(bits))


def _left(number: Column, bits: str) -> Column:
    return F.call_function("shiftleft", number, F.col(bits))


# Seconds of a time bin, points of one above which it is cut again, and points of a tile.
BIN_S, BIN_POINTS, TILE = 3600, 20_000, 256


def rows_in_spans(spans: DataFrame, points: DataFrame, ts: str = "ts", bin_s: int = BIN_S, bin_points: int = BIN_POINTS, tile: int = TILE) -> DataFrame:
    """Each row of ``points`` with each span ``lo`` to ``hi``, both included, that its time lies in; all columns of both.

    Points lie in one bin of time, and spans are dealt to the bins that they cover and that hold points; both meet by
    equal bins. A bin with many points is cut: its points are spread by a hash over so many parts, and its spans go to
    each of them. Neighbours in time of a part are put together in tiles; a span meets whole tiles, which are opened
    after it and compared row by row. So a span comes once for each run of rows and a tile comes again after few rows:
    a columnar file that the result is written to holds both in little space.
    """
    binned = points.where(F.col(ts).isNotNull()).withColumn("_bin", F.floor(F.col(ts) / F.lit(bin_s)).cast("long"))
    parts = F.ceil(F.count("*") / F.lit(bin_points)).cast("int").alias("_parts")
    # one row for each bin of time
    bins = broadcast_if_small(materialize(binned.groupBy("_bin").agg(parts)))
    bounds = binned.agg(F.min("_bin").alias("low"), F.max("_bin").alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    spread = binned.join(bins, "_bin").withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.col("_parts")).cast("int")).drop("_parts")
    place = F.row_number().over(Window.partitionBy("_bin", "_part").orderBy(ts)) - 1
    # the result is far larger than both sides, so their bytes do not tell how many tasks it needs
    tiles = (
        dealt(spread, "_bin", "_part")
        .withColumn("_tile", F.floor(place / F.lit(tile)))
        .groupBy("_bin", "_part", "_tile")
        .agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.collect_list(F.struct(*points.columns)).alias("_points"))
    )
    first = F.greatest(F.floor(F.col("lo") / F.lit(bin_s)).cast("long"), low)
    last = F.least(F.floor(F.col("hi") / F.lit(bin_s)).cast("long"), high)
    some = spans.where(F.col("lo") <= F.col("hi")).withColumns({"_first": first, "_n": last - first + 1})
    dealt_out = counted_out(some, "_n", "_k").withColumn("_bin", F.col("_first") + F.col("_k")).drop("_first", "_n", "_k")
    copies = dealt_out.join(bins, "_bin").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    met = tiles.join(dealt(copies, "_bin", "_part"), ["_bin", "_part"]).where((F.col("lo") <= F.col("_to")) & (F.col("hi") >= F.col("_from")))
    opened = met.select(F.explode("_points").alias("_point"), *spans.columns).select("_point.*", *spans.columns)
    return opened.where(F.col(ts).between(F.col("lo"), F.col("hi")))


# ---- host metrics ----------------------------------------------------------------


def slot(ts: Column, resolution: int = RESOLUTION) -> Column:
    """Start of the resolution slot of an epoch-seconds column."""
    return (F.floor(ts / F.lit(resolution)) * resolution).cast("long")


def pick_metrics(metrics: DataFrame, fragments: Sequence[str] = (), exclude_hosts: Sequence[str] = ()) -> DataFrame:
    """Metrics whose name contains a fragment; hidden names and excluded hosts dropped."""
    out = metrics.where(~F.col("metric").startswith(".") & ~F.col("host").startswith("."))
    if exclude_hosts:
        out = out.where(~F.col("host").isin(*exclude_hosts))
    if fragments:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.col("metric").contains(fragment)
        out = out.where(hit)
    return out


def slot_means(metrics: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """``host, metric, ts, value``: the mean of each slot that holds a value."""
    known = metrics.where(F.col("value").isNotNull())
    return known.groupBy("host", "metric", slot(F.col("ts"), resolution).alias("ts")).agg(F.avg("value").alias("value"))


def gap_runs(points: DataFrame, keys: Sequence[str], order: str, value: str, first: Column, last: Column, step: int, slices: int | None = None) -> DataFrame:
    """The regular axis from ``first`` to ``last`` as runs: ``keys, order, value, next_order, next_value, slots``.

    A run starts at a known point and has all slots before the next one; the run of a key's last point reaches the end
    of the axis and has no next point. Where a key's first point lies behind the start of the axis, a run without a value
    comes before it. Slots themselves are nowhere: what moves is one row for each known point, whatever the axis has.
    Points lie on the axis, one at most in each slot of a key, and their values are not null.
    """
    keys = list(keys)
    rows = sliced(points.select(*keys, order, value), keys, [order], slices)
    here = inside(keys, [order])
    point = F.struct(F.col(order).alias("at"), F.col(value).alias("v"))
    local = rows.withColumns({"_next": F.lead(point).over(here), "_before": F.lag(order).over(here)})
    # the first point of each slice is the next one of the last point of the slice before
    heads = rows.groupBy(*keys, SLICE).agg(F.min_by(point, order).alias("_head"))
    carried = heads.withColumns({"_later": F.lead("_head").over(across(keys)), "_first": F.lag("_head").over(across(keys)).isNull()})
    joined = null_safe_join(local, carried.drop("_head"), [*keys, SLICE])
    after = F.coalesce("_next", "_later")
    ahead = F.col("_first") & F.col("_before").isNull() & (F.col(order) > first)
    slots = lambda a, b: F.floor((b - a) / F.lit(step)).cast("long")
    null = F.lit(None).cast(points.schema[value].dataType)
    own = F.struct(
        F.col(order).alias(order), F.col(value).alias(value), after["at"].alias(f"next_{order}"), after["v"].alias(f"next_{value}"),
        F.when(after.isNull(), slots(F.col(order), last) + 1).otherwise(slots(F.col(order), after["at"])).alias("slots"),
    )
    lead_in = F.struct(
        first.cast("long").alias(order), null.alias(value), F.col(order).alias(f"next_{order}"), F.col(value).alias(f"next_{value}"),
        slots(first, F.col(order)).alias("slots"),
    )
    return joined.select(*keys, F.explode(F.when(ahead, F.array(lead_in, own)).otherwise(F.array(own))).alias("_run")).select(*keys, "_run.*")


def opened_runs(runs: DataFrame, keys: Sequence[str], order: str, value: str, step: int) -> DataFrame:
    """Every slot of the runs: ``keys, order, value, filled``. The value is NULL in the slots of a gap; ``filled`` lies on
    the line between the points on both sides of it, or is the nearest value where one side has none."""
    each = counted_out(runs, "slots", "_k")
    at, k = F.col(order) + F.col("_k") * step, F.col("_k")
    low, high = F.col(value), F.col(f"next_{value}")
    line = low + (high - low) * k / F.col("slots")
    known = F.when(k == 0, low)
    filled = F.when(low.isNull(), high).when(high.isNull() | (k == 0), low).otherwise(line)
    return each.select(*keys, at.cast("long").alias(order), known.alias(value), filled.alias("filled"))


SERIES = ["host", "metric"]


def fetch_runs(metrics: DataFrame, start: int, end: int, resolution: int = RESOLUTION, exclude_hosts: Sequence[str] = ()) -> DataFrame:
    """Averages per (host, metric, slot) of the range, both ends included, with the gaps as runs (``gap_runs``)."""
    inside_range = pick_metrics(metrics, exclude_hosts=exclude_hosts).where(F.col("ts").between(start, end))
    first, last = start // resolution * resolution, end // resolution * resolution
    return gap_runs(slot_means(inside_range, resolution), SERIES, "ts", "value", F.lit(first), F.lit(last), resolution)


def fetch(metrics: DataFrame, start: int, end: int, resolution: int = RESOLUTION, exclude_hosts: Sequence[str] = ()) -> DataFrame:
    """Average per (host, metric, slot) of the range, both ends included. Every slot of the range is returned for
    each (host, metric) that has a value in it; slots without values are NULL."""
    runs = fetch_runs(metrics, start, end, resolution, exclude_hosts)
    return opened_runs(runs, SERIES, "ts", "value", resolution).select("ts", *SERIES, "value")


def axis_runs(metrics: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """All slots between the first and the last one of the table, for every (host, metric) with a value, as runs."""
    bounds = metrics.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    low, high = (slot(bounds.select(c).scalar(), resolution) for c in ("low", "high"))
    return gap_runs(slot_means(metrics, resolution), SERIES, "ts", "value", low, high, resolution)


def on_axis(metrics: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """Every slot between the first and last one of the table for every (host, metric);
    missing slots are NULL."""
    return opened_runs(axis_runs(metrics, resolution), SERIES, "ts", "value", resolution).select("ts", *SERIES, "value")


def interpolated_axis(metrics: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """``host, metric, ts, value, filled``: the whole series at ``resolution``, gaps filled on the line between their
    ends."""
    return opened_runs(axis_runs(metrics, resolution), SERIES, "ts", "value", resolution)


def host_mean(metrics: DataFrame) -> DataFrame:
    """Mean over hosts per (ts, metric); byte counters in KB."""
    value = F.when(F.col("metric").startswith("bytes"), bytes_to_kb(F.col("value"))).otherwise(F.col("value"))
    return metrics.groupBy("ts", "metric").agg(F.avg(value).alias("value"), F.count("value").alias("hosts"))


def cpu_use(metrics: DataFrame, with_wait: bool = False) -> DataFrame:
    """CPU utilisation per ts: mean user share, optionally plus mean wait-io share."""
    user = F.avg(F.when(F.col("metric") == "cpu_user", F.col("value")))
    wait = F.avg(F.when(F.col("metric") == "cpu_wio", F.col("value")))
    return metrics.groupBy("ts").agg((user + wait if with_wait else user).alias("cpu_use"))


def host_sum(metrics: DataFrame, divide_by: float = 1.0) -> DataFrame:
    """Sum over hosts per (ts, metric), divided when asked."""
    return metrics.groupBy("ts", "metric").agg((F.sum("value") / divide_by).alias("value"))


def memory_use(metrics: DataFrame) -> DataFrame:
    """Used and free memory in percent per ts: per host first, then the mean over hosts."""

    def part(name: str) -> Column:
        return F.sum(F.when(F.col("metric") == name, F.col("value")))

    free = sum((F.coalesce(f"_{m}", F.lit(0.0)) for m in ("mem_free", "mem_cached", "mem_buffers")), F.lit(0.0))
    hosts = metrics.groupBy("ts", "host").agg(
        *[part(m).alias(f"_{m}") for m in ("mem_total", "mem_free", "mem_cached", "mem_buffers")]
    )
    used = (F.col("_mem_total") - free) / F.nullif(F.col("_mem_total"), F.lit(0.0)) * 100.0
    mean = F.avg("used")
    return hosts.withColumn("used", used).groupBy("ts").agg(mean.alias("mem_used"), (F.lit(100.0) - mean).alias("mem_free"))


def memory_use_by_class(metrics: DataFrame, large_hosts: Sequence[str], large_total: float, small_total: float) -> DataFrame:
    """Variant: free memory against a fixed total per host class (name fragment)."""
    large = F.lit(False)
    for fragment in large_hosts:
        large = large | F.col("host").contains(fragment)
    total = F.when(large, F.lit(large_total)).otherwise(F.lit(small_total))
    share = F.avg(F.col("value") / total * 100.0)
    return metrics.where(F.col("metric") == "mem_free").groupBy("ts").agg(
        share.alias("mem_free"), (F.lit(100.0) - share).alias("mem_used")
    )


def map_means(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Mean and count of each map key per ``key``, every group kept."""
    return (
        rows.select(key, F.explode(values).alias("name", "value"))
        .groupBy(key, "name")
        .agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    )


def iteration_means(runs: DataFrame, run: str, order: Sequence[str], value: str, slices: int | None = None) -> DataFrame:
    """Mean of the i-th value over all runs (i from 0)."""
    ranked = rank_within(runs, [run], order, "_i", slices)
    return ranked.groupBy((F.col("_i") - 1).alias("iteration")).agg(F.avg(value).alias("mean"), F.count(value).alias("runs"))


def interpolated(series: DataFrame, keys: Sequence[str], order: str, value: str, slices: int | None = None) -> DataFrame:
    """``keys, order, value, filled``: missing values interpolated linearly on the row
    index of the series; ends take the nearest known value.

    Known points are carried inside a slice, and from slice to slice by its first and
    last row.
    """
    keys = list(keys)
    rows = sliced(series.select(*keys, order, value), keys, [order], slices)
    here = inside(keys, [order])
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    # both frames grow with the rows; one that shrinks to the end would be read anew for every row
    upwards = Window.partitionBy(*keys, SLICE).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    downwards = Window.partitionBy(*keys, SLICE).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_i", F.row_number().over(here).cast("long")).withColumns(
        {"_lo": F.last(point, ignorenulls=True).over(upwards), "_hi": F.last(point, ignorenulls=True).over(downwards)}
    )
    marked = local.withColumn("_tail", F.lead("_i").over(here).isNull()).where(F.col("_tail") | (F.col("_i") == 1))
    ends = marked.groupBy(*keys, SLICE).agg(
        F.max("_i").alias("_n"),
        F.max(F.when(F.col("_tail"), F.col("_lo"))).alias("_lo_end"),
        F.max(F.when(F.col("_i") == 1, F.col("_hi"))).alias("_hi_head"),
    )
    before = across(keys).rowsBetween(Window.unboundedPreceding, -1)
    after = across(keys).rowsBetween(1, Window.unboundedFollowing)
    start = F.col("_i0")

    def moved(p: Column) -> Column:
        return F.when(p.isNotNull(), F.struct((start + p["i"]).alias("i"), p["v"].alias("v")))

    carried = ends.withColumn("_i0", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).withColumns(
        {
            "_lo0": F.last(moved(F.col("_lo_end")), ignorenulls=True).over(before),
            "_hi0": F.first(moved(F.col("_hi_head")), ignorenulls=True).over(after),
        }
    )
    joined = null_safe_join(local, carried.select(*keys, SLICE, "_i0", "_lo0", "_hi0"), [*keys, SLICE])
    lo, hi = F.coalesce(moved(F.col("_lo")), F.col("_lo0")), F.coalesce(moved(F.col("_hi")), F.col("_hi0"))
    return joined.select(*keys, order, value, _between(value, start + F.col("_i"), lo, hi).alias("filled"))


def _between(value: str, index: Column, lo: Column, hi: Column) -> Column:
    """Value at ``index`` on the line between two known points (structs of index and value)."""
    line = lo["v"] + (hi["v"] - lo["v"]) * (index - lo["i"]) / F.nullif(hi["i"] - lo["i"], F.lit(0))
    known = F.col(value)
    return F.when(known.isNotNull(), known).when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(line)


def empirical_cdf(values: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], slices: int | None = None) -> DataFrame:
    """Adds ``cdf`` = rank / (n - 1) of the sorted values; ties keep distinct ranks."""
    ranked = rank_within(values.where(F.col(value).isNotNull()), keys, [value, *tie], "_rank", slices)
    sizes = values.groupBy(*keys).agg(F.count(value).alias("_n"))
    return (
        ranked.join(sizes, list(keys))
        .withColumn("cdf", (F.col("_rank") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)))
        .drop("_rank", "_n")
    )


def normal_curve(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds normal ``cdf`` and ``pdf`` with the population mean and deviation per key."""
    moments = values.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    v, mean, std = F.col(value), F.col("_mean"), F.nullif(F.col("_std"), F.lit(0.0))
    return (
        values.join(moments, list(keys))
        .withColumns({"cdf": normal_cdf(v, mean, std), "pdf": normal_pdf(v, mean, std)})
        .drop("_mean", "_std")
    )


def standard_error(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return values.groupBy(*keys).agg((F.stddev_pop(value) / F.sqrt(F.nullif(F.count(value), F.lit(0)))).alias("std_error"))


def unit_histogram(values: DataFrame, column: str, limit: Column | int | None = None) -> DataFrame:
    """Counts in the unit bins 0 .. limit - 2, empty ones included; the last bin includes its upper edge. Without a
    limit the bins reach the greatest value."""
    v = F.col(column)
    if limit is None:
        limit = values.agg((F.floor(F.max(column)) + 2).alias("top")).select("top").scalar()
    top = F.lit(limit) if isinstance(limit, int) else limit
    kept = values.where((v >= 0) & (v <= top - 1))
    counts = kept.groupBy(F.least(F.floor(v), top - 2).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return _every_bin(counts, (top - 1).cast("long"))


def _every_bin(counts: DataFrame, bins: Column) -> DataFrame:
    """All bins 0 .. bins - 1, with 0 where nothing was counted."""
    one = counts.sparkSession.range(1).select(F.coalesce(bins, F.lit(0)).cast("long").alias("_n"))
    axis = counted_out(one, "_n", "bin").select("bin")
    return axis.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def equal_histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts of the truncated values in ``bins`` equal bins between their min and max, empty ones included."""
    whole = values.select(F.col(column).cast("long").alias("_v")).where("_v is not null")
    bounds = whole.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    place = F.floor((F.col("_v") - lo) * bins / F.nullif(hi - lo, F.lit(0)))
    counts = whole.groupBy(F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return _every_bin(counts, F.lit(bins))


def partition_sizes(df: DataFrame) -> DataFrame:
    """First, smallest, largest and mean partition size, and the number of partitions."""
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.min_by("n", "part").alias("first"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
        F.avg("n").alias("mean"), F.count("*").alias("partitions"),
    )


def key_sums(entries: DataFrame) -> DataFrame:
    """Dictionary accumulator: key-wise sum."""
    return entries.groupBy("key").agg(F.sum("value").alias("total"))


def key_lists(entries: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """List accumulator in long form: the position of each value in its key's list. The
    lists stay rows, so a hot key is never one array."""
    return rank_within(entries, ["key"], order, "pos", slices)


# ---- tasks and stages ------------------------------------------------------------


def good_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks without an error that ran at all; stage 0 is left out."""
    return tasks.where(F.col("error").isNull() & (F.col("run_ms") != 0) & (F.col("stage") != 0))


def task_wait(tasks: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Waiting time of a task: each part in whole seconds, summed."""
    return tasks.withColumns(
        {
            "wait_s": sum((whole_seconds(F.col(p)) for p in parts), F.lit(0).cast("long")),
            "run_s": whole_seconds(F.col("run_ms")),
        }
    )


def longest_stages(stages: DataFrame) -> DataFrame:
    """The longest stage of a short run, the seven longest of a long one, by id."""
    real = stages.where(F.col("stage") != 0)
    top = real.orderBy(F.desc("run_s"), "stage").limit(TOP_MANY)
    # at most seven rows reach this window
    ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("run_s"), "stage")))
    wanted = F.when(real.agg(F.count("*")).scalar() < FEW_STAGES, TOP_FEW).otherwise(TOP_MANY)
    return ranked.where(F.col("_r") <= wanted).drop("_r").orderBy("stage")


def flat_json(rows: DataFrame, key: str, document: str) -> DataFrame:
    """Leaves of a JSON document as (path, value) rows; the path joins the object keys and array positions with
    underscores. Null leaves keep their row, with a NULL value. A document that is no JSON has no leaves.

    Documents are opened level by level, as deep as the deepest goes. What a level gives is written once: leaves as
    text, and inner nodes, which alone are opened next. So each level is computed once, from the one before.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("_key"), F.lit("").alias("_path"), F.try_parse_json(F.col(document)).alias("_node"))
    leaves = None
    while True:
        # columns of a member: pos, key (NULL in an array) and value
        members = level.lateralJoin(spark.tvf.variant_explode(F.col("_node").outer()))
        prefix = F.when(F.col("_path") == "", "").otherwise(F.concat("_path", F.lit("_")))
        kind = F.schema_of_variant("value")
        inner = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
        opened = materialize(members.select(
            "_key", F.concat(prefix, F.coalesce("key", F.col("pos").cast("string"))).alias("_path"),
            inner.alias("_inner"), F.when(~inner, F.col("value").cast("string")).alias("_value"), F.when(inner, F.col("value")).alias("_node"),
        ))
        here = opened.where("not _inner").select(F.col("_key").alias(key), F.col("_path").alias("path"), F.col("_value").alias("value"))
        leaves = here if leaves is None else leaves.unionAll(here)
        level = opened.where("_inner").select("_key", "_path", "_node")
        if level.isEmpty():
            return leaves


# ---- result comparison ------------------------------------------------------------


def wide_results(results: DataFrame, configs: Sequence[str]) -> DataFrame:
    """One column per configuration, averaged over repeats."""
    return results.groupBy("experiment", "manager").agg(
        *[F.avg(F.when(F.col("config") == c, F.col("seconds"))).alias(c) for c in configs]
    )


def compare_results(results: DataFrame, configs: Sequence[str], base: str) -> DataFrame:
    """Difference to and speed-up over the base configuration, back in long form."""
    wide = wide_results(results, configs)
    others = [c for c in configs if c != base]
    return wide.unpivot(["experiment", "manager", base], others, "config", "seconds").select(
        "experiment", "manager", "config", "seconds",
        (F.col(base) - F.col("seconds")).alias("saved"),
        (F.col(base) / F.nullif(F.col("seconds"), F.lit(0.0))).alias("speed_up"),
    )
