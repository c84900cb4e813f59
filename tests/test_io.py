import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clusterlens.functions import ids
from clusterlens.operators import cells, extract
from clusterlens.operators.windows import WindowSpec
from clusterlens.plans import flows
from clusterlens.sinks import records, snapshots
from clusterlens.sources import logs
from clusterlens.streaming import actions, queries

C2 = "container_1502222838299_0001_01_000002"
APP = "application_1502222838299_0001"
T0 = datetime(2020, 1, 1)


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_container_and_daemon_logs(spark, tmp_path, rows):
    write(tmp_path / APP / C2 / "stderr", "one\ntwo\n")
    write(tmp_path / APP / C2 / "deep" / "stdout", "three\n")
    write(tmp_path / APP / "other" / "x", "not a container\n")
    out = logs.read_container_logs(spark, str(tmp_path))
    assert rows(out, "container_id", "line") == [(C2, "one"), (C2, "three"), (C2, "two")]
    write(tmp_path / "nm.log", "2020-01-01 00:00:00,1 a\n2020-01-02 00:00:00,1 b\n")
    daemon = logs.read_daemon_log(spark, str(tmp_path / "nm.log"), "nodemanager", since="2020-01-02")
    assert rows(daemon, "source", "line") == [("nodemanager", "2020-01-02 00:00:00,1 b")]


def test_log_streams(spark, tmp_path, rows):
    write(tmp_path / "in" / APP / C2 / "stderr", "2020-01-01 00:00:00 one\n2020-01-03 00:00:00 two\n")
    root = str(tmp_path / "in")
    streams = {
        "container": logs.read_container_logs(spark, root, streaming=True),
        "daemon": logs.read_daemon_log(spark, root, "nm", since="2020-01-02", streaming=True),
    }
    for name, stream in streams.items():
        sink = queries.append_table(str(tmp_path / name))
        query = queries.start(stream, sink, f"logs-{name}", str(tmp_path / "progress"), trigger=None)
        assert query.awaitTermination(120)
    both = [("2020-01-01 00:00:00 one",), ("2020-01-03 00:00:00 two",)]
    assert rows(spark.read.parquet(str(tmp_path / "container")), "line") == both
    assert rows(spark.read.parquet(str(tmp_path / "daemon")), "line") == both[1:]


def test_legacy_charset(spark, tmp_path, rows):
    write(tmp_path / C2 / "stderr", '任务 "完成", ok\n第二行\n', "gbk")
    out = logs.read_container_logs(spark, str(tmp_path), encoding="GBK")
    assert rows(out, "container_id", "line") == [(C2, '任务 "完成", ok'), (C2, "第二行")]


def test_keyed_records_from_files(spark, tmp_path, rows):
    df = spark.createDataFrame([("k", "v", T0, 1)], logs.RECORD_SCHEMA)
    df.write.parquet(str(tmp_path / "m"))
    back = logs.read_messages(spark, {"path": str(tmp_path / "m")})
    assert rows(back) == rows(df)


def test_new_app_containers(spark, rows):
    containers = spark.createDataFrame([(C2,), ("container_1_0002_01_000001",)], "container_id STRING")
    apps = spark.createDataFrame([(APP, T0), ("application_1_0002", datetime(2019, 1, 1))], "app_id STRING, ts TIMESTAMP")
    out = logs.containers_of_new_apps(containers, apps, F.lit(T0))
    assert rows(out, "container_id") == [(C2,)]


def nested(spark, ticks, memory):
    data = [(t, C2, APP, memory, {"task": [("task", {"TID": "1"}, 1.0)]}, {}) for t in ticks]
    fields = "STRUCT<key STRING, identifiers MAP<STRING,STRING>, value DOUBLE>"
    df = spark.createDataFrame(
        data,
        f"tick BIGINT, container_id STRING, app_id STRING, memory DOUBLE, period_messages MAP<STRING,ARRAY<{fields}>>, "
        f"instant_messages MAP<STRING,ARRAY<{fields}>>",
    )
    rest = [c for c in logs.SNAPSHOT_FIELDS.values() if c not in df.columns]
    return df.select("*", *[F.lit(0.5).alias(c) for c in rest])


def test_snapshot_round_trip_and_merge(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    assert snapshots.write_snapshot(nested(spark, [], 0.0), path, "json") is None
    first = snapshots.write_snapshot(nested(spark, [1, 2], 1.0), path, "json")
    second = snapshots.write_snapshot(nested(spark, [2, 3], 2.0), path, "json")
    assert [p.rsplit("/", 1)[1] for p in (first, second)] == ["sliding_window0", "sliding_window1"]
    back = logs.read_snapshots(spark, [first, second])
    merged = logs.merge_snapshots(back, logs.snapshot_number(F.col("source")))
    assert rows(merged, "tick", "memory", "cpu") == [(1, 1.0, 0.5), (2, 2.0, 0.5), (3, 2.0, 0.5)]
    assert rows(logs.snapshot_messages(merged), "tick", "kind", "key", "value") == [
        (1, "period", "task", 1.0), (2, "period", "task", 1.0), (3, "period", "task", 1.0),
    ]


def test_one_line_snapshot(spark, tmp_path, rows):
    cell = {"containerId": "c", "timestamp": 5, "CPU": 0.1, "memory": 7.0, "periodMessages": {}, "instantMessages": {}}
    path = tmp_path / "sliding_window3.json"
    path.write_text(json.dumps({"5": {"c": cell, "d": cell}, "6": {"c": cell}}))
    out = logs.read_snapshots(spark, str(path))
    assert rows(out, "tick", "container_id", "memory") == [(5, "c", 7.0), (5, "d", 7.0), (6, "c", 7.0)]


def test_run_modes(spark, tmp_path):
    path = str(tmp_path / "runs")
    spec = WindowSpec(2, 2)
    assert flows.run(spark, "storage", path, spec, nested(spark, [1, 2], 1.0)).endswith("sliding_window0")
    assert flows.run(spark, "storage", path, spec, nested(spark, [2, 3], 2.0)).endswith("sliding_window1")
    stored = flows.run(spark, "training", path, spec)
    live = flows.run(spark, "detection", path, spec, nested(spark, [1, 2, 3], 2.0))
    shape = {(r.tick, r.window_start, r.n_ticks) for r in live.toLocalIterator()}
    assert shape == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
    assert {(r.tick, r.window_start, r.n_ticks) for r in stored.toLocalIterator()} == shape
    with pytest.raises(ValueError):
        flows.run(spark, "other", path, spec)


def test_app_snapshots(spark, tmp_path):
    path = str(tmp_path / "apps")
    finished = spark.createDataFrame([(APP,)], "app_id STRING")
    other = nested(spark, [1], 1.0).withColumn("app_id", F.lit("application_9_0009"))
    snapshots.write_app_snapshots(nested(spark, [1, 2], 1.0).unionByName(other), finished, path)
    assert {r.app_id for r in spark.read.parquet(path).select("app_id").toLocalIterator()} == {APP}


def points(spark):
    data = [
        ("period:task", T0, 1.0, {"container": C2, "app": APP}),
        ("plain", T0, 2.5, {"host": "node1"}),
        ("no.tags", T0, 1.0, {}),
    ]
    return records.to_points(
        spark.createDataFrame(data, "key STRING, ts TIMESTAMP, value DOUBLE, tags MAP<STRING,STRING>")
    )


def test_points(spark, rows):
    out = [json.loads(r.json) for r in records.point_json(points(spark)).toLocalIterator()]
    ms = 1577836800000
    assert out == [
        {"metric": "task", "timestamp": ms, "value": 1.0, "tags": {"container": "01_000002", "app": "1502222838299_0001"}},
        {"metric": "plain", "timestamp": ms, "value": 2.5, "tags": {"host": "node1"}},
    ]
    assert rows(records.rejected_points(points(spark)), "metric") == [("no.tags",)]


def test_point_writer(spark, tmp_path):
    out = tmp_path / "posts"
    out.mkdir()

    def post(url, body):
        import os
        import uuid

        with open(os.path.join(str(out), uuid.uuid4().hex), "w") as f:
            f.write(url + "\n" + body)
        return ""

    records.points_foreach_batch("host:4242", batch=1, post=post)(points(spark), 0)
    posts = [p.read_text().split("\n") for p in out.iterdir()]
    assert sorted(json.loads(body)[0]["metric"] for _, body in posts) == ["plain", "task"]
    assert {url for url, _ in posts} == {"http://host:4242/api/put"}
    with pytest.raises(Exception, match="unexpected answer"):
        records.points_foreach_batch("host", post=lambda u, b: "error")(points(spark), 0)


def test_record_texts(spark, rows):
    line = spark.createDataFrame([(C2, "text")], "container_id STRING, line STRING")
    assert rows(records.to_log_messages(line)) == [(f"{C2}-log", f"{C2} text")]
    daemon = spark.createDataFrame([("nodemanager", "text")], "source STRING, line STRING")
    assert rows(records.to_log_messages(daemon)) == [("nodemanager-log", "text")]


def test_short_tags_of_pseudo_container(spark):
    tags = F.create_map(F.lit("container"), F.lit(APP), F.lit("x"), F.lit("y"))
    row = spark.range(1).select(ids.short_tags(tags).alias("t")).first()
    assert row.t == {"container": "1502222838299_0001", "x": "y"}


def test_qualified_keys(spark):
    df = spark.createDataFrame([("period:task:x",), ("plain",)], "k STRING")
    type_, name = extract.unqualify(F.col("k"))
    assert [tuple(r) for r in df.select(type_, name).toLocalIterator()] == [("period", "task"), (None, "plain")]


def test_pseudo_containers(spark, rows):
    df = spark.createDataFrame([("c", "a"), ("null", "a"), (None, "a"), (None, None)], "container_id STRING, app_id STRING")
    assert rows(cells.container_or_app(df), "container_id") == [("a",), ("a",), ("c",)]
    assert rows(cells.valid_container(df), "container_id") == [("c",)]


def test_action_list():
    found = actions.parse("pkg.mod:run:1000, other:go:5 ,broken:x,./dir.jar/x:y:1")
    assert found == [actions.ActionInfo("pkg.mod", "run", 1000), actions.ActionInfo("other", "go", 5)]
    assert actions.resolve(actions.ActionInfo("json", "dumps", 1)) is json.dumps


def test_metric_messages_write_counters_in_plain_digits(spark):
    line = f"{C2},2020-01-01 00:00:00.000,1.5,13948000,98999000,2,3,4,5000000000,6"
    samples = flows.samples(spark.createDataFrame([(1, f"{C2}-metric", line, "metric")], "seq BIGINT, key STRING, value STRING, route STRING"))
    out = records.to_metric_messages(samples).first()
    assert out.value == f"{C2},2020-01-01 00:00:00.000,1.5,13948000.0,98999000.0,2.0,3.0,4.0,5000000000.0,6.0"
