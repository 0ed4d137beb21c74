"""Stages and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.registry import query, table
from furrow.functions.text import bytes_to_kb, kb_to_gb, whole_seconds
from furrow.operators import telemetry as T
from furrow.sources.logs import stages_of, tasks_of

WAIT_PARTS = ("deserialize_ms", "serialize_ms", "fetch_ms", "gc_ms")


def tasks(spark, sf):
    """Order lines as tasks: prices and quantities become milliseconds."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_linenumber").alias("stage_raw"), (F.col("l_linenumber") - 1).alias("stage"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("task"),
        F.when(F.col("l_returnflag") == "R", "lost").alias("error"),
        F.when(F.col("l_quantity") == 1, 0).otherwise(F.col("l_extendedprice").cast("long")).alias("run_ms"),
        (F.col("l_quantity") * 100).cast("long").alias("deserialize_ms"),
        F.floor(F.col("l_extendedprice") / 7).cast("long").alias("serialize_ms"),
        F.col("l_partkey").alias("fetch_ms"), (F.col("l_suppkey") * 10).alias("gc_ms"),
        F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


TASKS_SQL = """with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber - 1 as stage,
    case when l_returnflag = 'R' then 'lost' end as error, case when l_quantity = 1 then 0 else trunc(l_extendedprice)::BIGINT end as run_ms,
    trunc(l_quantity * 100)::BIGINT as deserialize_ms, floor(l_extendedprice / 7)::BIGINT as serialize_ms, l_partkey as fetch_ms,
    l_suppkey * 10 as gc_ms from lineitem)"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("f05_good_tasks", TASKS_SQL + " select l_orderkey, l_linenumber, l_partkey, l_suppkey, run_ms from t where error is null and run_ms <> 0 and stage <> 0")
def _(spark, sf):
    return T.good_tasks(tasks(spark, sf)).select(*KEYS, "run_ms")


@query("a27_task_wait", TASKS_SQL + """ select l_orderkey, l_linenumber, l_partkey, l_suppkey, (deserialize_ms // 1000 + serialize_ms // 1000
    + fetch_ms // 1000 + gc_ms // 1000)::BIGINT as wait_s, run_ms // 1000 as run_s from t""")
def _(spark, sf):
    return T.task_wait(tasks(spark, sf), WAIT_PARTS).select(*KEYS, "wait_s", "run_s")


@query("p05_units", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1024 as kb,
    trunc(l_extendedprice * 1000 / 1000000)::BIGINT as gb, floor(l_partkey / 1000)::BIGINT as s from lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    return li.select(
        *KEYS, bytes_to_kb(price).alias("kb"), kb_to_gb(price * 1000).alias("gb"), whole_seconds(F.col("l_partkey")).alias("s")
    )


def _stage_documents(spark, sf):
    """Every event as a stage list of one, running for ``value`` seconds."""
    e = table(spark, sf, "events")
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'"
    done = F.col("ts") + F.make_dt_interval(secs=F.floor("value"))
    text = F.concat(
        F.lit('[{"stageId": '), F.col("event_id").cast("string"), F.lit(', "submissionTime": "'), F.date_format("ts", stamp),
        F.lit('", "completionTime": "'), F.date_format(done, stamp), F.lit('", "unused": 1}]'),
    )
    return e.select(text.alias("value"))


@query("s12_stages", "select event_id::INT as stage, floor(value)::BIGINT as run_s from events")
def _(spark, sf):
    return stages_of(_stage_documents(spark, sf))


@query("o03_longest_stages", """select stage, run_s from (select event_id::INT as stage, floor(value)::BIGINT as run_s from events where event_id <> 0
    order by run_s desc, stage limit 7) order by stage""")
def _(spark, sf):
    return T.longest_stages(stages_of(_stage_documents(spark, sf)))


@query("s12_tasks", """select l_orderkey, l_linenumber, (l_partkey * 10 + l_linenumber)::BIGINT as task_id, 'host-' || l_suppkey as host,
    case when l_returnflag = 'R' then 'lost' end as error, trunc(l_extendedprice)::BIGINT as run_ms, l_partkey as gc_ms,
    case when l_linestatus = 'O' then l_suppkey else 0 end as fetch_ms, 0::BIGINT as bytes_read from lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    fetched = F.when(F.col("l_linestatus") == "O", F.struct(F.col("l_suppkey").alias("fetchWaitTime")))
    task = F.struct(
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("taskId"), F.concat(F.lit("host-"), F.col("l_suppkey").cast("string")).alias("host"),
        F.when(F.col("l_returnflag") == "R", "lost").alias("errorMessage"),
        F.struct(
            F.col("l_extendedprice").cast("long").alias("executorRunTime"), F.col("l_partkey").alias("jvmGcTime"), fetched.alias("shuffleReadMetrics")
        ).alias("taskMetrics"),
    )
    documents = li.select("l_orderkey", "l_linenumber", F.to_json(F.array(task)).alias("value"))
    return tasks_of(documents).select("l_orderkey", "l_linenumber", "task_id", "host", "error", "run_ms", "gc_ms", "fetch_ms", "bytes_read")
