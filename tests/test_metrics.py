from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clusterlens.operators import cells, metrics

C = "container_15_0001_01_000002"
GOOD = f"{C},2020-01-01 00:00:00.5,0.3,10,1,2,3,4,5,6"
T0 = datetime(2020, 1, 1)


def test_parse_and_rejects(spark, rows):
    bad = [GOOD.rsplit(",", 1)[0], GOOD.replace("0.3", "x"), GOOD.replace("2020-01-01 00:00:00.5", "noon")]
    tagged = GOOD + ",host:a,junk,host:b,empty:,zone:z:w"
    df = spark.createDataFrame(list(enumerate([GOOD, tagged, *bad])), "seq BIGINT, value STRING")
    parsed = metrics.parse_metric_lines(df)
    got = {r.seq: r for r in parsed.toLocalIterator()}
    assert sorted(got) == [0, 1]
    assert got[0].net_rate == 11.0 and got[0].ts == T0 + timedelta(milliseconds=500)
    ids = {"app": "application_15_0001", "container": C}
    assert got[0].tags == ids
    assert got[1].tags == {**ids, "host": "b", "zone": "z"}
    assert rows(metrics.rejected_lines(df), "seq") == [(2,), (3,), (4,)]
    assert metrics.unpivot(parsed).count() == 14


def series(spark, values, columns):
    data = [("a", T0 + timedelta(seconds=i), *v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"container_id STRING, ts TIMESTAMP, {columns}")


@pytest.mark.parametrize("cut", [{}, {"width": 2_000_000}, {"width": 60_000_000, "split_rows": 2}])
def test_counters(spark, cut):
    df = series(spark, [(0, 10), (5, 20), (4, 30), (4, 30)], "used BIGINT, total BIGINT")
    ratio = metrics.counter_ratio(df, "used", "total", "container_id", "ts", **cut).orderBy("ts")
    assert [r.rate for r in ratio.toLocalIterator()][:3] == [0.0, 0.5, 0.0]
    rate = metrics.counter_rate(df, ["total"], "container_id", "ts", **cut).orderBy("ts")
    assert [r.total_rate for r in rate.toLocalIterator()] == [0.0, 0.01, 0.01, 0.0]


@pytest.mark.parametrize("cut", [{}, {"width": 1_000_000}, {"width": 60_000_000, "split_rows": 2}])
def test_baseline(spark, cut):
    df = series(spark, [(0,), (7,), (9,), (0,), (12,)], "rx BIGINT")
    out = metrics.baseline(df, "rx", "container_id", "ts", "net", **cut).orderBy("ts")
    assert [r.net for r in out.toLocalIterator()] == [0, 0, 2, -7, 5]


def test_zero_fill(spark):
    samples = spark.createDataFrame([("a", T0 + timedelta(seconds=3), 5.0)], "container_id STRING, ts TIMESTAMP, cpu DOUBLE")
    starts = spark.createDataFrame([("a", T0), ("b", T0)], "container_id STRING, ts TIMESTAMP")
    out = metrics.zero_fill_leading(samples, starts, ["cpu"])
    count = {(r.container_id, r.filled): r["count"] for r in out.groupBy("container_id", "filled").count().toLocalIterator()}
    assert count == {("a", False): 1, ("a", True): 3, ("b", True): 10}


def test_cells(spark, rows):
    points = [("01_000001", "1", datetime.fromtimestamp(i), "cpu", 0.3, i) for i in range(1, 11)]
    points += [("null", "1", T0, "cpu", 1.0, 11), (None, "1", T0, "cpu", 1.0, 12)]
    points += [("01_000001", None, datetime.fromtimestamp(1), "cpu", 0.4, 13)]
    df = spark.createDataFrame(
        points, "container_id STRING, app_id STRING, ts TIMESTAMP, metric STRING, value DOUBLE, seq BIGINT"
    )
    out = cells.metric_cells(df, 1000)
    assert out.count() == 10
    first = out.orderBy("tick").first()
    assert (first.cpu, first.memory, first.app_id) == (0.4, 0.0, "1")


def facts(spark, data):
    return spark.createDataFrame(
        data,
        "container_id STRING, app_id STRING, ts TIMESTAMP, type STRING, name STRING, "
        "tags MAP<STRING,STRING>, value DOUBLE, seq BIGINT",
    )


def test_message_maps(spark):
    data = []
    for i in range(1, 11):
        for task in ("t1", "t2"):
            tags = {"container": f"01_{task}", "app": "app1", "task": task, "state": "s1"}
            data.append((f"01_{task}", "app1", datetime.fromtimestamp(i), "period", "task", tags, 1.0, i))
    long = cells.cell_messages(facts(spark, data), 1000)
    maps = cells.message_maps(long)
    assert maps.count() == 20
    row = maps.where(F.col("container_id") == "01_t1").first()
    message = row.period_messages["task"][0]
    assert (message.key, message.identifiers, message.value) == ("task", {"task": "t1", "state": "s1"}, 1.0)
    assert row.instant_messages == {}


def test_crowded_cell_stays_one_cell(spark):
    data = [("c", "a", T0, "event", "k", {"n": str(i)}, float(i), i) for i in range(50)]
    long = cells.cell_messages(facts(spark, data), 1000)
    cell = spark.createDataFrame([(long.first().tick, "c", "a", 8.0)], "tick BIGINT, container_id STRING, app_id STRING, memory DOUBLE")
    row = cells.nested(cell, cells.message_maps(long)).collect()
    assert [(r.container_id, r.memory) for r in row] == [("c", 8.0)]
    assert [m.value for m in row[0].instant_messages["k"]] == [float(i) for i in range(50)]


def test_build_aligns_both_sides(spark, rows):
    samples = spark.createDataFrame(
        [("c1", "a", T0, 1, *[float(i) for i in range(7)])],
        "container_id STRING, app_id STRING, ts TIMESTAMP, seq BIGINT, cpu DOUBLE, memory DOUBLE, "
        "disk_service_byte DOUBLE, disk_service_time DOUBLE, disk_wait_time DOUBLE, disk_io_time DOUBLE, net_rate DOUBLE",
    )
    messages = facts(
        spark,
        [
            ("c1", "a", T0, "instant", "x", {}, 1.0, 2),
            (None, "a", T0, "instant", "app.state", {"app": "a"}, 8.0, 3),
            (None, None, T0, "instant", "lost", {}, 8.0, 4),
            ("c2", None, T0, None, "plain", {}, 1.0, 5),
        ],
    )
    built = cells.build(samples, messages, 1000)
    assert rows(built, "container_id", "app_id", "memory", "has_metrics", "n_messages") == [
        ("a", "a", 0.0, False, 1),
        ("c1", "a", 1.0, True, 1),
        ("c2", None, 0.0, False, 0),
    ]
    assert cells.message_counts(cells.cell_messages(messages, 1000)).count() == 2


def test_active_containers(spark, rows):
    df = spark.createDataFrame(
        [(0, "a"), (0, "b"), (1000, "a"), (1000, "b"), (2000, "a")], "tick BIGINT, container_id STRING"
    )
    assert rows(cells.active_containers(df)) == [(0, 2), (2000, 1)]


def test_zero_fill_longer_than_its_limit_adds_nothing(spark):
    samples = spark.sql("SELECT 'c' AS container_id, timestamp'2020-01-01 00:00:05' AS ts, 1.0D AS cpu")
    starts = spark.sql("SELECT 'c' AS container_id, timestamp'2020-01-01 00:00:00' AS ts")
    out = metrics.zero_fill_leading(samples, starts, ["cpu"], interval_ms=2000, limit_ms=1000)
    assert [(r.cpu, r.filled) for r in out.collect()] == [(1.0, False)]


def test_put_address_keeps_its_scheme():
    from clusterlens.sinks import records

    assert records.put_url("https://h:1") == "https://h:1/api/put"
    assert records.put_url("h:1") == "http://h:1/api/put"
