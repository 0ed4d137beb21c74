"""Readers and writers on small generated files."""

import json

import pytest
from pyspark.sql import functions as F

from furrow.operators import telemetry as T
from furrow.sources import files, logs, sinks


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name in ("a/x.jpg", "a/y.JPG", "a/z.jpeg", "a/w.Jpg", "b/c/v.tiff", "b/u.PNG", "b/t.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    (root / "a/empty.png").write_bytes(b"")
    return root


def test_scan_and_listing(spark, tree):
    assert {r["path"].rsplit("/", 1)[-1] for r in files.scan(spark, str(tree / "a"), glob="*.jpg").collect()} == {"x.jpg"}
    assert files.scan(spark, str(tree), partitions=3, recursive=True).rdd.getNumPartitions() == 3


def test_collected_catalog(spark, tree):
    names = {r["name"].rsplit("_", 1)[-1] for r in files.collect_catalog(spark, str(tree)).collect()}
    assert names == {"ax.jpg", "ay.JPG", "cv.tiff", "bu.PNG"}


def test_pack_and_unpack(spark, tree, tmp_path):
    files.pack(files.scan(spark, str(tree), recursive=True), str(tmp_path / "bundle"))
    back = files.unpack(spark, str(tmp_path / "bundle"))
    content = {r["png_name"]: bytes(r["content"]).decode() for r in back.collect()}
    assert content["v.png"] == "b/c/v.tiff" and "t.png" in content


def test_event_log(spark, tmp_path):
    lines = [
        {"Event": T.APP_START, "App Name": "flowerCounter_1", "Timestamp": 1000},
        {"Event": T.EXECUTOR_ADDED, "Timestamp": 3500, "Executor ID": "0", "Executor Info": {"Host": "h"}},
        {"Event": T.APP_END, "Timestamp": 9000},
    ]
    (tmp_path / "app-1").write_text("\n".join([json.dumps(x) for x in lines] + ["{broken", ""]))
    (tmp_path / "app-1.json").write_text(json.dumps(lines[0]))
    log = logs.event_log(spark, str(tmp_path))
    assert log.count() == 3
    times = T.job_times(log).first()
    assert (times["app"], times["waiting"], times["execution"], times["total"]) == ("app-1", 2.5, 5.5, 8.0)


def test_metric_sheet(spark, tmp_path):
    (tmp_path / "cpu.csv").write_text(
        "Timestamp, node-1 cpu_user, node 2 cpu_user\n2017-02-01T14:22:00-06:00,10.5,20\n2017-02-01T14:22:15-06:00,,30\n"
    )
    rows = logs.metric_sheet(spark, str(tmp_path / "cpu.csv")).collect()
    got = {(r["ts"] - 1485958920, r["host"], r["metric"]): r["value"] for r in rows}
    assert got == {(0, "node-1", "cpu_user"): 10.5, (0, "node 2", "cpu_user"): 20.0,
                   (15, "node-1", "cpu_user"): None, (15, "node 2", "cpu_user"): 30.0}


def test_stages_and_tasks(spark, tmp_path):
    stage = {"stageId": 3, "submissionTime": "2017-06-10T23:08:53.100GMT", "completionTime": "2017-06-10T23:09:03.900GMT"}
    (tmp_path / "stages.json").write_text(json.dumps([stage], indent=2))
    assert [tuple(r) for r in logs.stages_of(logs.json_documents(spark, str(tmp_path / "stages.json"))).collect()] == [(3, 10)]
    metrics = {"executorRunTime": 5200, "executorDeserializeTime": 1999, "jvmGcTime": 1000, "resultSerializationTime": 1,
               "shuffleReadMetrics": {"fetchWaitTime": 2500}}
    tasks = [{"taskId": 1, "host": "h", "taskMetrics": metrics}, {"taskId": 2, "host": "h", "errorMessage": "lost", "taskMetrics": metrics}]
    (tmp_path / "tasks.json").write_text(json.dumps(tasks))
    rows = logs.tasks_of(logs.json_documents(spark, str(tmp_path / "tasks.json"))).withColumn("stage", F.lit(3))
    wait = T.task_wait(T.good_tasks(rows), ("deserialize_ms", "serialize_ms", "fetch_ms", "gc_ms")).collect()
    assert [(r["task_id"], r["wait_s"], r["run_s"]) for r in wait] == [(1, 1 + 0 + 2 + 1, 5)]


def test_run_logs(spark, tmp_path):
    (tmp_path / "run.txt").write_text("start\nImage proc. time: 12.5 sec\nImage proc. time: 3 sec\n")
    assert sorted(r["seconds"] for r in logs.logged_times(spark.read.text(str(tmp_path / "run.txt"))).collect()) == [3.0, 12.5]
    (tmp_path / "exp").write_text("---\nExperiment start time: 100 => x\nSubmitted a on 105 => y\nExperiment end time: 900 => z\n")
    assert tuple(logs.experiment_bounds(spark.read.text(str(tmp_path / "exp"))).first()) == (100, 900)


def test_node_metrics(spark, tmp_path):
    line = {"timestamp": 5, "values": {"sigar": {"cpu": 0.5, "ram": 2}, "filesystem": {"root": 1}}}
    (tmp_path / "m.json").write_text("\n".join([json.dumps(line), json.dumps({**line, "values": {"sigar": {"cpu": 1.5}}}), "nope"]))
    rows = logs.node_metric_lines(spark.read.text(str(tmp_path / "m.json")))
    means = {r["name"]: (r["value"], r["n"]) for r in T.map_means(rows, "ts", "sigar").collect()}
    assert means == {"cpu": (1.0, 2), "ram": (2.0, 1)}


def test_float_lines(spark, tmp_path):
    (tmp_path / "points.txt").write_text("0.0 0.1 0.2\n9 9.6 9.10\n\n")
    assert [r["p"] for r in logs.float_lines(spark.read.text(str(tmp_path / "points.txt"))).collect()] == [[0.0, 0.1, 0.2], [9.0, 9.6, 9.1]]


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "name STRING, flowers INT").repartition(2)
    for _ in range(2):  # the second run replaces the first
        sinks.one_text_file(df, str(tmp_path / "one"))
    parts = list((tmp_path / "one").glob("part-*"))
    assert len(parts) == 1 and sorted(parts[0].read_text().split()) == ["a,1", "b,2"]
    sinks.tab_separated(df, str(tmp_path / "tab"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "tab")).collect()) == ["a\t1", "b\t2"]
    sinks.sorted_json(df.select("name", "flowers"), str(tmp_path / "json"))
    assert '{"flowers":1,"name":"a"}' in {r["value"] for r in spark.read.text(str(tmp_path / "json")).collect()}


def test_records_and_timings(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2])], "path STRING, hist ARRAY<INT>")
    sinks.save_records(df, str(tmp_path / "records"))
    assert sinks.load_records(spark, str(tmp_path / "records")).first() == df.first()
    for total in (1.0, 2.0):
        sinks.append_timing(sinks.timing_record(spark, "job", 0.5, total), str(tmp_path / "timing"))
    assert sorted(r["total_s"] for r in sinks.load_records(spark, str(tmp_path / "timing")).collect()) == [1.5, 2.5]


def test_literal_results(spark):
    rows = [("blocks", "yarn", "static", 100.0), ("blocks", "yarn", "dynamic", 50.0), ("blocks", "mesos", "static", 80.0)]
    df = spark.createDataFrame(rows, "experiment STRING, manager STRING, config STRING, seconds DOUBLE")
    got = {r["manager"]: (r["saved"], r["speed_up"]) for r in T.compare_results(df, ["static", "dynamic"], "static").collect()}
    assert got == {"yarn": (50.0, 2.0), "mesos": (None, None)}


def test_flat_json(spark):
    doc = json.dumps({"a": {"b": [1, {"c": "x"}]}, "d": None, "e": True, "f": {"g": {"h": {"i": {"j": 5}}}}})
    df = spark.createDataFrame([(1, doc), (2, None)], "k INT, doc STRING")
    got = {(r["path"], r["value"]) for r in T.flat_json(df, "k", "doc").collect()}
    assert got == {("a_b_0", "1"), ("a_b_1_c", "x"), ("d", None), ("e", "true"), ("f_g_h_i_j", "5")}


@pytest.mark.parametrize("split", ["200b", "1k", "128m"])
def test_line_numbers_do_not_follow_splits(spark, tmp_path, split):
    """Lines of several files, cut anywhere, keep their numbers; a line longer than a split and empty ones do too."""
    import random

    rng = random.Random(1)
    texts = {}
    for name in ("app-1", "app-2", "app-3"):
        lines = ["x" * rng.randrange(0, 60) + f"-{k}" for k in range(rng.randrange(1, 200))]
        lines[len(lines) // 2] = "long" * 300
        lines.insert(3, "")
        texts[name] = lines
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "app-2" else ""))
    (tmp_path / "app-4").write_text("")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, split)
    try:
        rows = logs.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(name, before)
    got = {}
    for r in rows:
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["line"], r["value"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v)) for k, v in texts.items()}


def test_small_splits_are_few_tasks(spark, tmp_path):
    """Thousands of splits are read by a few tasks, and their size does not reach the tables written on the way."""
    for k in range(3):
        (tmp_path / f"app-{k}").write_text("".join(f"line {n} of {k}\n" for n in range(3000)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    rows = logs.numbered_lines(spark, str(tmp_path), "50b")
    got = {(r["file"][-1], r["line"], r["value"]) for r in rows.collect()}
    assert got == {(str(k), n, f"line {n} of {k}") for k in range(3) for n in range(3000)}
    assert spark.conf.get(name) == before and spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
    assert len(rows.inputFiles()) <= 2 * 4 * 4 + 4


def test_written_logs_are_read_in_order(spark, tmp_path):
    """Events of one time stay in the order of their ids, one file an app."""
    events = [("a", T.APP_START, 5, 3), ("a", T.EXECUTOR_ADDED, 5, 4), ("a", T.EXECUTOR_REMOVED, 5, 9), ("b", T.APP_END, 1, 1), (None, T.APP_END, 1, 2)]
    df = spark.createDataFrame(events, "app STRING, event STRING, ts_ms BIGINT, event_id BIGINT").repartition(3)
    assert {tuple(r) for r in logs.write_event_logs(df, str(tmp_path / "logs")).collect()} == {("a", 3), ("b", 1)}
    back = logs.event_log(spark, str(tmp_path / "logs"))
    assert sorted((r["app"], r["event_id"], r["event"]) for r in back.collect()) == [("a", 0, T.APP_START), ("a", 1, T.EXECUTOR_ADDED), ("a", 2, T.EXECUTOR_REMOVED), ("b", 0, T.APP_END)]


def test_several_roots(spark, tmp_path):
    for name in ("1108-01/cam/a.png", "1108-01/b.png", "1108-02/a.png", "1108-03/a.png", "1109-01/a.png", "1108-04.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "1108-02/t.txt").write_bytes(b"1")
    found = files.read_datasets(spark, str(tmp_path), "1108-", ["1108-03"], glob=files.IMAGE_GLOB).select("dataset", "path", "length")
    assert sorted((r["dataset"], r["path"].rsplit("/", 1)[-1]) for r in found.collect()) == [("1108-01", "a.png"), ("1108-01", "b.png"), ("1108-02", "a.png")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan and "1108-03" not in plan
    assert files.read_datasets(spark, str(tmp_path), "2000-").count() == 0
    assert files.subfolders(spark, str(tmp_path), "1108-", ["1108-01"]) == [f"file:{tmp_path}/1108-02", f"file:{tmp_path}/1108-03"]


def test_walk_lists_images_only(spark, tree):
    plan = files.collect_catalog(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_broken_images_are_left_out(spark, tmp_path):
    """Text, an empty file and files cut anywhere are no images; the others are decoded."""
    import numpy as np

    from furrow.operators import png

    content = png.encode(np.arange(48, dtype=np.uint8).reshape(4, 4, 3))
    (tmp_path / "good.png").write_bytes(content)
    (tmp_path / "grey.png").write_bytes(png.encode(np.zeros((4, 4), np.uint8)))
    (tmp_path / "text.png").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    for at in (4, 20, 40, len(content) - 20):
        (tmp_path / f"cut{at}.png").write_bytes(content[:at])
    rows = files.decoded(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in rows if "cut" not in r["path"]] == ["good.png"]
    assert np.frombuffer(bytes(rows[0]["data"]), np.uint8).reshape(4, 4, 3)[..., ::-1].ravel().tolist() == list(range(48))
