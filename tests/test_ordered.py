"""Prefix operators against plain Python, with one key that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import ordered as O
from furrow.operators import telemetry as T


def rows(n=600, seed=1):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.randrange(200), i, rng.choice([None, 1.0, 2.5, -3.0]))
        for i in range(n)
    ]


@pytest.fixture()
def data(spark):
    table = rows()
    return table, spark.createDataFrame(table, "k STRING, t BIGINT, id BIGINT, v DOUBLE").repartition(5)


def by_key(table):
    out = {}
    for row in sorted(table, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


def test_a_hot_key_is_cut(data):
    table, df = data
    cut = O.sliced(df, ["k"], ["t", "id"], 16)
    sizes = {(r["k"], r[O.SLICE]): r["count"] for r in cut.groupBy("k", O.SLICE).count().collect()}
    assert sum(k == "hot" for k, _ in sizes) >= 8
    assert max(n for (k, _), n in sizes.items() if k == "hot") < len(table) / 6


def test_ties_are_cut(spark):
    """Ten thousand rows of one key and one order value spread by the column after it."""
    df = spark.range(10_000).selectExpr("'a' as k", "5 as t", "id")
    sizes = [r["count"] for r in O.sliced(df, ["k"], ["t", "id"], 16).groupBy(O.SLICE).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2000
    ranked = O.rank_within(df, ["k"], ["t", "id"], slices=16)
    assert ranked.where("rank <> id + 1").count() == 0


@pytest.mark.parametrize("slices", [1, 16, 40])
def test_running_sum(data, slices):
    table, df = data
    got = {r["id"]: r["s"] for r in O.running_sums(df, ["k"], ["t", "id"], {"s": F.col("id")}, slices).collect()}
    for series in by_key(table).values():
        total = 0
        for row in series:
            total += row[2]
            assert got[row[2]] == total


def test_rows_without_key_are_kept(spark):
    df = spark.createDataFrame([(None, i, i) for i in range(40)] + [("a", 3, 90)], "k STRING, t BIGINT, id BIGINT")
    got = {r["id"]: r["rank"] for r in O.rank_within(df, ["k"], ["t", "id"], slices=8).collect()}
    assert got == {**{i: i + 1 for i in range(40)}, 90: 1}


def test_rank_and_index(spark, data):
    table, df = data
    ranks = {r["id"]: r["rank"] for r in O.rank_within(df, ["k"], ["t", "id"], slices=7).collect()}
    for series in by_key(table).values():
        assert [ranks[r[2]] for r in series] == list(range(1, len(series) + 1))
    index = {r["id"]: r["row_index"] for r in O.row_index(df, "k", "t", "id").collect()}
    ordered = sorted(table, key=lambda r: (r[0], r[1], r[2]))
    assert [index[r[2]] for r in ordered] == list(range(len(table)))


def test_one_value_in_the_order_column(spark):
    df = spark.createDataFrame([("a", 5, i) for i in range(20)], "k STRING, t BIGINT, id BIGINT")
    assert sorted(r["rank"] for r in O.rank_within(df, ["k"], ["t", "id"]).collect()) == list(range(1, 21))


def test_timeline_is_the_counter_machine(spark):
    rng = random.Random(3)
    names = [*T.LISTENER_EVENTS, "SparkListenerJobStart"]
    table = [(f"app{min(rng.randrange(6), 2)}", rng.choice(names), rng.randrange(10_000), i) for i in range(500)]
    df = spark.createDataFrame(table, "app STRING, event STRING, ts_ms BIGINT, event_id BIGINT")
    got = {r["event_id"]: (r["executors"], r["next_ms"]) for r in T.executor_timeline(df, 12).collect()}
    series = {}
    for row in sorted(table, key=lambda r: (r[2], r[3])):
        if row[1] in T.LISTENER_EVENTS:
            series.setdefault(row[0], []).append(row)
    assert len(got) == sum(map(len, series.values()))
    for events in series.values():
        count = 0
        for event, later in zip(events, [*events[1:], None], strict=True):
            if event[1] in (T.APP_START, T.APP_END):
                count = 0
            else:
                count += 1 if event[1] == T.EXECUTOR_ADDED else -1
            assert got[event[3]] == (count, later[2] if later else None)


def test_filled_every_second(spark):
    df = spark.createDataFrame([("a", 1, 0, 5000, 3), ("a", 2, 5000, 5400, 4), ("a", 3, 5400, None, 0)],
                               "app STRING, event_id BIGINT, ts_ms BIGINT, next_ms BIGINT, executors BIGINT")
    got = sorted((r["at_ms"], r["executors"]) for r in T.filled(df).collect())
    assert got == [(0, 3), (1000, 3), (2000, 3), (3000, 3), (4000, 3), (5000, 4), (5400, 0)]
    long = spark.createDataFrame([("a", 1, 0, 10_000_000, 1)], df.schema)
    assert T.filled(long).select("at_ms").distinct().count() == 10_000


def test_interpolation_on_a_hot_series(spark):
    """Every slice cut, against numpy."""
    rng = random.Random(5)
    table = [("hot" if i % 3 else "cold", i, rng.choice([None, None, float(rng.randrange(50))])) for i in range(400)]
    df = spark.createDataFrame(table, "k STRING, ts BIGINT, v DOUBLE")
    got = {r["ts"]: r["filled"] for r in T.interpolated(df, ["k"], "ts", "v", 25).collect()}
    for key in ("hot", "cold"):
        series = [r for r in table if r[0] == key]
        known = [(i, r[2]) for i, r in enumerate(series) if r[2] is not None]
        want = np.interp(range(len(series)), *zip(*known, strict=True))
        assert np.allclose([got[r[1]] for r in series], want)


def test_interpolation_is_linear_on_the_row_index(spark):
    values = [None, 2.0, None, None, 8.0, None]
    df = spark.createDataFrame([("s", i * 10, v) for i, v in enumerate(values)], "k STRING, ts BIGINT, v DOUBLE")
    got = [r["filled"] for r in T.interpolated(df, ["k"], "ts", "v", 3).orderBy("ts").collect()]
    assert got == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]
