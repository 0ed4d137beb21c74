"""Event logs, metric exports and run logs as tables.

Each reader is ``spark.read`` plus a pure function on the raw lines, so lines that come
from another table go through the same parsing.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions.text import metric_seconds
from furrow.schemas import EVENT_LINE, NODE_METRICS, STAGES, TASKS
from furrow.session import broadcast_if_small, stored
from furrow.sources.output import Output, qualified

# Lines of run and experiment logs.
PROC_TIME = r"Image proc\. time: ([0-9.]+)"
EXPERIMENT_START = r"Experiment start time: (\d+)"
EXPERIMENT_END = r"Experiment end time: (\d+)"


def float_lines(lines: DataFrame) -> DataFrame:
    """Lines of blank-separated numbers as ``p ARRAY<DOUBLE>``."""
    return lines.where(F.trim("value") != "").withColumn("p", F.split(F.trim("value"), " +").cast("array<double>"))


def event_lines(lines: DataFrame) -> DataFrame:
    """Parses event JSON lines (``value`` plus any other columns); malformed lines go."""
    parsed = lines.withColumn("_e", F.from_json("value", EVENT_LINE)).where(F.col("_e.Event").isNotNull())
    return parsed.select(
        *[c for c in lines.columns if c != "value"],
        F.col("_e.Event").alias("event"), F.col("_e.Timestamp").alias("ts_ms"),
        F.col("_e.`App Name`").alias("app_name"), F.col("_e.`Executor ID`").alias("executor_id"),
    )


@contextmanager
def cut_into(spark: SparkSession, size: str | None):
    """Files that are read inside are cut into splits of at most ``size``, and splits are put together into a few tasks
    for each shuffle partition, so that small splits are not as many tasks; None leaves the session as it is."""
    if size is None:
        yield
        return
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def numbered_lines(spark: SparkSession, path: str | Sequence[str], split_size: str | None = None) -> DataFrame:
    """``file, line, value``: every line of the files with its number in its file, from 0.

    The number does not depend on how files are cut into splits and splits into tasks. Lines are read once and written
    with the split that they came from and their place among the rows of their task; splits then follow one another by
    their first byte, and what moves between tasks is one row for each split. ``split_size`` holds for the files alone:
    the tables that are written on the way are read as the session says.
    """
    split = ["file", "_start"]
    with cut_into(spark, split_size):
        rows = stored(spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"), "value",
        ))
    # a split is read by one task without a break, so its rows have consecutive ids
    splits = rows.groupBy(*split).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(broadcast_if_small(stored(starts), 400), split)
    return joined.select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def event_log(spark: SparkSession, path: str | Sequence[str], split_size: str | None = None) -> DataFrame:
    """Logs of a folder; the app is the file name, and files with an extension are skipped. ``event_id`` is the number
    of the line, so events of one time stay in the order of the file."""
    lines = numbered_lines(spark, path, split_size).withColumn("app", F.substring_index("file", "/", -1))
    return event_lines(lines.where(~F.col("app").contains(".")).select("value", "app", F.col("line").alias("event_id")))


def write_event_logs(events: DataFrame, folder: str) -> DataFrame:
    """One log file for each app, a JSON text a line, in order of time and id; returns ``app, lines`` when run. A task
    writes its apps one after another and holds a batch of lines at a time."""
    target = qualified(events.sparkSession, folder)

    def run(batches):
        app, file, lines = None, None, 0
        for pdf in batches:
            for name, value in zip(pdf["app"], pdf["value"], strict=True):
                if name != app:
                    if file is not None:
                        file.commit()
                        yield pd.DataFrame({"app": [app], "lines": [lines]})
                    app, file, lines = name, Output(f"{target}/{name}"), 0
                file.file.write(value.encode() + b"\n")
                lines += 1
        if file is not None:
            file.commit()
            yield pd.DataFrame({"app": [app], "lines": [lines]})

    text = F.to_json(F.struct(F.col("event").alias("Event"), F.col("ts_ms").alias("Timestamp"), F.col("app").alias("App Name")))
    rows = events.where(F.col("app").isNotNull()).select("app", "ts_ms", "event_id", text.alias("value"))
    ordered = rows.repartition("app").sortWithinPartitions("app", "ts_ms", "event_id")
    return ordered.select("app", "value").mapInPandas(run, "app STRING, lines BIGINT")


def long_metrics(wide: DataFrame, time: str = "Timestamp") -> DataFrame:
    """Wide metric sheet to ``ts, host, metric, value``; headers are trimmed and split at
    the last blank into host and metric."""
    trimmed = wide.toDF(*[c.strip() for c in wide.columns])
    names = [c for c in trimmed.columns if c != time]
    numbers = trimmed.select(metric_seconds(F.col(time)).alias("ts"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    long = numbers.unpivot(["ts"], [f"`{c}`" for c in names], "_name", "value")
    return long.select(
        "ts",
        F.regexp_extract("_name", r"^(.*) [^ ]+$", 1).alias("host"),
        F.regexp_extract("_name", r"([^ ]+)$", 1).alias("metric"),
        "value",
    )


def metric_sheet(spark: SparkSession, path: str) -> DataFrame:
    return long_metrics(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path))


def stages_of(documents: DataFrame, document: str = "value") -> DataFrame:
    """``stage, run_s`` from the stage list JSON (times cut at the fraction)."""
    stage = documents.select(F.inline(F.from_json(document, STAGES)))
    return stage.select(
        F.col("stageId").alias("stage"),
        (metric_seconds(F.col("completionTime")) - metric_seconds(F.col("submissionTime"))).alias("run_s"),
    )


def tasks_of(documents: DataFrame, document: str = "value") -> DataFrame:
    """Flat task rows from the task list JSON; other columns of ``documents`` stay."""
    keep = [c for c in documents.columns if c != document]
    task = documents.select(*keep, F.explode(F.from_json(document, TASKS)).alias("t"))
    m = "t.taskMetrics"
    return task.select(
        *keep,
        F.col("t.taskId").alias("task_id"), F.col("t.host").alias("host"), F.col("t.executorId").alias("executor_id"),
        F.col("t.taskLocality").alias("locality"), F.col("t.errorMessage").alias("error"),
        F.col(f"{m}.executorRunTime").alias("run_ms"),
        *[
            F.coalesce(F.col(f"{m}.{source}"), F.lit(0)).alias(name)
            for source, name in (
                ("executorDeserializeTime", "deserialize_ms"),
                ("resultSerializationTime", "serialize_ms"),
                ("shuffleReadMetrics.fetchWaitTime", "fetch_ms"),
                ("jvmGcTime", "gc_ms"),
                ("resultSize", "result_size"),
                ("memoryBytesSpilled", "memory_spilled"),
                ("diskBytesSpilled", "disk_spilled"),
                ("inputMetrics.bytesRead", "bytes_read"),
                ("inputMetrics.recordsRead", "records_read"),
                ("outputMetrics.bytesWritten", "bytes_written"),
                ("shuffleReadMetrics.remoteBytesRead", "remote_bytes"),
                ("shuffleReadMetrics.localBytesRead", "local_bytes"),
                ("shuffleWriteMetrics.writeTime", "write_time"),
            )
        ],
    )


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as ``value, file``."""
    files = spark.read.text(path, wholetext=True)
    return files.select("value", F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"))


def logged_times(lines: DataFrame) -> DataFrame:
    """``seconds`` of the processing-time lines; other lines go."""
    return lines.withColumn("_s", F.regexp_extract("value", PROC_TIME, 1)).where("_s <> ''").withColumn(
        "seconds", F.col("_s").cast("double")
    ).drop("_s", "value")


def experiment_bounds(lines: DataFrame) -> DataFrame:
    """Start and end epoch seconds of an experiment log."""

    def at(pattern: str):
        return F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).cast("bigint")

    return lines.agg(F.min(at(EXPERIMENT_START)).alias("start_s"), F.max(at(EXPERIMENT_END)).alias("end_s"))


def node_metric_lines(lines: DataFrame) -> DataFrame:
    """``ts, sigar, filesystem`` maps per JSON line."""
    parsed = lines.withColumn("_m", F.from_json("value", NODE_METRICS)).where("_m.timestamp is not null")
    return parsed.select(
        *[c for c in lines.columns if c != "value"],
        F.col("_m.timestamp").alias("ts"), F.col("_m.values.sigar").alias("sigar"),
        F.col("_m.values.filesystem").alias("filesystem"),
    )
