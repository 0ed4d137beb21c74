"""Gap runs, intervals and spans against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from furrow.catalog import QUERIES
from furrow.operators import telemetry as T


def sparse(seed, n=120, hosts=3, last=6000):
    """Metric rows with long gaps, rows on one time, null values and one series of most rows."""
    rng = random.Random(seed)
    rows = [(rng.randrange(last), "hot" if rng.random() < 0.6 else f"h{rng.randrange(hosts)}", rng.choice("mn"), round(rng.uniform(-5, 5), 3)) for _ in range(n)]
    return rows + [(17, "hot", "m", None), (3000, "silent", "m", None), (17, "hot", "m", 1.0)]


def slots_of(rows, first, last, step):
    """Mean of each slot, and the value on the line between known slots."""
    means = {}
    for ts, host, metric, value in rows:
        if value is not None and first <= ts // step * step <= last:
            means.setdefault((host, metric), {}).setdefault(ts // step * step, []).append(value)
    out = {}
    for key, found in means.items():
        known = {t: sum(v) / len(v) for t, v in found.items()}
        times = sorted(known)
        for t in range(first, last + 1, step):
            before, after = [x for x in times if x <= t], [x for x in times if x >= t]
            if t in known:
                filled = known[t]
            elif not before or not after:
                filled = known[after[0] if after else before[-1]]
            else:
                a, b = before[-1], after[0]
                filled = known[a] + (known[b] - known[a]) * (t - a) / (b - a)
            out[(*key, t)] = (known.get(t), filled)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts BIGINT, host STRING, metric STRING, value DOUBLE").repartition(4)


def close(got, want):
    assert got.keys() == want.keys()
    for key, (value, filled) in want.items():
        assert got[key][0] == pytest.approx(value) and got[key][1] == pytest.approx(filled)


def test_whole_axis(spark):
    rows = sparse(1)
    first, last = min(r[0] for r in rows) // 15 * 15, max(r[0] for r in rows) // 15 * 15
    got = {(r["host"], r["metric"], r["ts"]): (r["value"], r["filled"]) for r in T.interpolated_axis(frame(spark, rows)).collect()}
    close(got, slots_of(rows, first, last, 15))
    values = {(r["host"], r["metric"], r["ts"]): (r["value"], 0) for r in T.on_axis(frame(spark, rows)).collect()}
    close(values, {k: (v, 0) for k, (v, _) in slots_of(rows, first, last, 15).items()})


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_runs_cover_the_axis_once(spark, slices):
    """Whatever the slices are, runs follow one another without a gap, and there is one for each known slot at most two."""
    rows = sparse(2, n=300)
    means = T.slot_means(frame(spark, rows))
    runs = T.gap_runs(means, ["host", "metric"], "ts", "value", F.lit(-300), F.lit(9000), 15, slices).collect()
    series = {}
    for r in runs:
        series.setdefault((r["host"], r["metric"]), []).append(r)
    assert len(runs) <= means.count() + len(series)
    for own in series.values():
        own.sort(key=lambda r: r["ts"])
        assert own[0]["ts"] == -300 and own[0]["value"] is None and own[-1]["next_ts"] is None
        for a, b in zip(own, own[1:]):
            assert a["ts"] + 15 * a["slots"] == b["ts"] == a["next_ts"] and a["next_value"] == b["value"]
        assert own[-1]["ts"] + 15 * own[-1]["slots"] == 9015


def test_fetch_range_and_hosts(spark):
    rows = sparse(3)
    got = {(r["host"], r["metric"], r["ts"]): (r["value"], 0) for r in T.fetch(frame(spark, rows), 100, 4000, exclude_hosts=["h1"]).collect()}
    inside = [r for r in rows if 100 <= r[0] <= 4000 and r[1] != "h1"]
    close(got, {k: (v, 0) for k, (v, _) in slots_of(inside, 90, 3990, 15).items()})
    assert T.fetch(frame(spark, []), 0, 100).count() == 0


def test_a_gap_moves_as_one_row(spark):
    """A gap of a million slots is one run until it is opened."""
    two = frame(spark, [(0, "h", "m", 1.0), (15_000_000, "h", "m", 2.0)])
    runs = T.axis_runs(two)
    assert sorted(r["slots"] for r in runs.collect()) == [1, 1_000_000]
    opened = T.interpolated_axis(two)
    assert opened.agg(F.count("*"), F.round(F.avg("filled"), 6)).first()[:] == (1_000_001, 1.5)


def test_intervals(spark):
    rows = [("a", 0, 0, 1, 2500), ("a", 1, 2500, 2, 2500), ("a", 2, 2500, 3, 2501), ("a", 3, 2501, 2, 5501), ("a", 4, 5501, 1, None), ("b", 5, 7, 1, 1_000_007)]
    line = spark.createDataFrame(rows, "app STRING, event_id BIGINT, ts_ms BIGINT, executors BIGINT, next_ms BIGINT")
    for step in (1, 2):
        spans = T.intervals(line, step).collect()
        want = {}
        for _, i, start, _, end in rows:
            end = start + step * 1000 if end is None else end
            want[i] = list(range(start, end, step * 1000)) or [start]
        assert {r["event_id"]: r["steps"] for r in spans} == {i: len(t) for i, t in want.items()}
        opened = {}
        for r in T.opened_steps(T.intervals(line, step), step).collect():
            opened.setdefault(r["event_id"], []).append(r["at_ms"])
        assert {i: sorted(t) for i, t in opened.items()} == want


def test_steps_per_bin(spark):
    """Counts of steps are those of the opened ones, for bins longer and shorter than a step; no single step is made."""
    rows = [("a", 0, 0, 1, 2500), ("a", 1, 2500, 2, 2500), ("a", 2, 2500, 3, 9999), ("a", 3, 9999, 2, 20_000), ("a", 4, -4100, 1, 3700), ("b", 5, 7, 1, None), ("b", 6, None, 4, 9), (None, 7, 5, 2, 8005)]
    line = spark.createDataFrame(rows, "app STRING, event_id BIGINT, ts_ms BIGINT, executors BIGINT, next_ms BIGINT")
    for step, width in ((1, 4000), (1, 3333), (2, 5000), (3, 700)):
        want = Counter((r["app"], r["event_id"], None if r["at_ms"] is None else r["at_ms"] // width, r["executors"]) for r in T.filled(line, step).collect())
        got = {(r["app"], r["event_id"], r["bin"], r["executors"]): r["steps"] for r in T.steps_per_bin(T.intervals(line, step), width, step).collect()}
        assert got == want
    ages = spark.createDataFrame([("a", 1, 0, 1, 10**15)], line.schema)
    assert T.steps_per_bin(T.intervals(ages), 10**13).agg(F.count("*"), F.sum("steps")).first()[:] == (100, 10**12)


def test_timeline_is_filled_by_seconds(spark, tmp_path):
    """The query opens every second of every app, on the times of the table."""
    kinds = {"signup": 0, "purchase": 1, "error": -1, "view": 0}
    rows = [(1, "2024-01-01 00:00:10.250", 3, "signup"), (2, "2024-01-01 00:59:58.000", 3, "purchase"), (4, "2024-01-01 02:00:01.500", 3, "view"), (5, "2024-01-01 01:00:00.000", 8, "purchase")]
    df = spark.createDataFrame(rows, "event_id BIGINT, ts STRING, user_id BIGINT, event_type STRING").withColumns({"ts": F.to_timestamp("ts"), "value": F.lit(1.0)})
    df.write.parquet(str(tmp_path / "events.parquet"))
    start = 1_704_067_200_000
    lines = [("other_3", 1, 10_250, 3_598_000, 0), ("other_3", 2, 3_598_000, 7_201_500, kinds["purchase"]), ("other_3", 4, 7_201_500, 7_202_500, 0), ("imageClustering_8", 5, 3_600_000, 3_601_000, 1)]
    want = {}
    for app, event, lo, hi, executors in lines:
        for at in range(start + lo, start + hi, 1000):
            want.setdefault((app, at // 3_600_000), []).append((at, executors, event))
    got = {(r["app"], r["hour"]): r[2:] for r in QUERIES["w07_filled_timeline"](spark, str(tmp_path)).collect()}
    assert got == {
        k: (len(v), min(at for at, *_ in v), max(at for at, *_ in v), min(e for _, e, _ in v), max(e for _, e, _ in v), sum(e for _, e, _ in v),
            sum(e * (at // 1000 % 3600) for at, e, _ in v), sum(i for *_, i in v))
        for k, v in want.items()
    }


SPANS = [("all", -10, 10_000), ("one", 500, 500), ("left", -100, 17), ("odd", 1, 2999), ("even", 1024, 2047), ("late", 5999, 5999), ("none", 7000, 9000),
         ("back", 50, 40), ("open", None, 10), ("ends", 10, None), ("same", 100, 4000), ("sama", 100, 4000)]


def pairs(rows):
    return [(name, r) for name, lo, hi in SPANS if lo is not None and hi is not None for r in rows if lo <= r[0] <= hi]


def test_rows_in_spans(spark):
    """One span over the whole range, spans of a second, empty and broken ones; bins are cut."""
    rows = sparse(4, n=400)
    spans = spark.createDataFrame(SPANS, "app STRING, lo BIGINT, hi BIGINT")
    for bin_s, bin_points in ((3600, 20_000), (600, 5), (7, 3)):
        got = T.rows_in_spans(spans, frame(spark, rows), bin_s=bin_s, bin_points=bin_points)
        found = [(r["app"], (r["ts"], r["host"], r["metric"], r["value"])) for r in got.collect()]
        assert sorted(found, key=str) == sorted(pairs(rows), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert T.rows_in_spans(spans, frame(spark, [])).count() == 0 and T.rows_in_spans(spans.limit(0), frame(spark, rows)).count() == 0


def test_rows_in_spans_in_runs(spark):
    """A span comes once for each tile, not once for each row; tiles of any size, nulls and equal rows lose nothing."""
    rows = sparse(4, n=300) + [(5, None, None, None)] * 4 + sparse(4, n=300)[:40]
    spans = spark.createDataFrame(SPANS + SPANS[:2], "app STRING, lo BIGINT, hi BIGINT")
    want = sorted(pairs(rows) + [p for name, _, _ in SPANS[:2] for p in pairs(rows) if p[0] == name], key=str)
    for tile in (1, 7, 256):
        got = T.rows_in_spans(spans, frame(spark, rows), bin_s=600, bin_points=50, tile=tile).collect()
        assert sorted(((r["app"], (r["ts"], r["host"], r["metric"], r["value"])) for r in got), key=str) == want
    points = frame(spark, [(k, "h", "m", float(k)) for k in range(1000)])
    long = spark.createDataFrame([(f"a{k}", 0, 2000) for k in range(40)], "app STRING, lo BIGINT, hi BIGINT")
    apps = [r["app"] for r in T.rows_in_spans(long, points, tile=100).collect()]
    assert len(apps) == 40 * 1000
    assert 1 + sum(a != b for a, b in zip(apps, apps[1:])) <= 40 * 10


def test_span_load(spark):
    rows = sparse(5, n=500)
    spans = spark.createDataFrame(SPANS, "app STRING, lo BIGINT, hi BIGINT")
    want = {}
    for name, (_, _, metric, value) in pairs(rows):
        if value is not None:
            want.setdefault((name, metric), []).append(value)
    got = {(r["app"], r["metric"]): (r["rows"], r["mean"], r["peak"]) for r in T.span_load(spans, frame(spark, rows), ["app"], ["metric"]).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == (len(values), pytest.approx(sum(values) / len(values)), max(values))
    assert T.span_load(spans, frame(spark, [(1, "h", "m", 2.0)]), ["app"]).count() == 3
    assert T.span_load(spans, frame(spark, []), ["app"]).count() == 0


def nested(depth):
    """One document with a leaf and a deeper object on every level."""
    doc = '{"end": [1, "two", null, {}, []]}'
    for k in range(depth):
        doc = f'{{"k{k}": {doc}, "leaf": {k}.5}}'
    return doc


def test_flat_json(spark):
    docs = [(1, nested(6)), (2, "no json"), (3, None), (4, "5"), (5, '[[1, [2]], {"a": true}]'), (6, "{}"), (7, nested(12))]
    got = T.flat_json(spark.createDataFrame(docs, "key INT, value STRING"), "key", "value")
    assert got.columns == ["key", "path", "value"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r["key"], {})[r["path"]] = r["value"]
    assert set(rows) == {1, 5, 7} and rows[5] == {"0_0": "1", "0_1_0": "2", "1_a": "true"}
    for key, depth in ((1, 6), (7, 12)):
        paths = ["_".join(f"k{j}" for j in range(depth - 1, k - 1, -1)) for k in range(depth, -1, -1)]
        want = {(f"{p}_" if p else "") + "leaf": f"{depth - 1 - k}.5" for k, p in enumerate(paths[:-1])}
        want |= {f"{paths[-1]}_end_0": "1", f"{paths[-1]}_end_1": "two", f"{paths[-1]}_end_2": None}
        assert rows[key] == want


def test_deep_documents_cost_by_level(spark):
    """Jobs grow with the depth, not with its square, and a level's plan reads one written table."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(depth):
        group = f"depth-{depth}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            found = T.flat_json(spark.createDataFrame([(1, nested(depth))], "id INT, doc STRING"), "id", "doc")
            n = found.count()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert n == depth + 3
        return len(tracker.getJobIdsForGroup(group)), found

    few, _ = jobs(6)
    many, found = jobs(12)
    assert many <= 2 * few
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "variant_explode" not in plan and "Exchange" not in plan
