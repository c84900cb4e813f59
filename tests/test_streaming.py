"""Streams drained with availableNow must equal their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clusterlens.operators import periods, windows
from clusterlens.operators.windows import WindowSpec
from clusterlens.streaming import actions, processors, queries

T0 = datetime(2020, 1, 1)
FAR = 100_000
FACTS = (
    "container_id STRING, app_id STRING, ts TIMESTAMP, type STRING, name STRING, tags MAP<STRING,STRING>, "
    "value DOUBLE, is_finish BOOLEAN, rule_id INT, group_id INT, seq BIGINT"
)


def at(second):
    return T0 + timedelta(seconds=second)


def as_stream(spark, path, batches, schema):
    """A file stream that delivers the given batches one after another."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, sink, name, tmp_path):
    query = queries.start(df, sink, name, str(tmp_path / "progress"), trigger=None)
    assert query.awaitTermination(300)


def collected(spark, path):
    return spark.read.parquet(f"{path}/batch_id=*")


def fact(container, tid, second, finish, seq):
    return (container, "a", at(second), "period", "task", {"TID": tid}, float(seq), finish, 0, 0, seq)


def test_periods(spark, tmp_path, rows):
    batches = [
        [fact("c1", "1", 3, False, 1), fact("c1", "2", 12, False, 3), fact("c2", "1", 10, False, 4)],
        [fact("c1", "1", 7, True, 2), fact("c2", "1", 20, True, 5), fact("c2", "9", 21, False, 6), fact("c2", "9", 23, False, 7)],
        [fact("c1", "2", 47, True, 8), fact("c2", "9", 44, True, 9), fact("c3", "1", 41, False, 10)],
        [fact("far", "1", FAR, False, 11)],
    ]
    marks = [("c3", at(63), 12)]
    facts = as_stream(spark, tmp_path / "in", batches, FACTS)
    batch = spark.createDataFrame([r for b in batches for r in b], FACTS)
    marks_df = spark.createDataFrame(marks, "container_id STRING, ts TIMESTAMP, seq BIGINT")
    expected = periods.expand(periods.pair(batch, marks_df), 10_000, F.lit(at(FAR - 1)))
    mark_path = tmp_path / "marks"
    marks_df.coalesce(1).write.parquet(str(mark_path))
    live = spark.readStream.schema(marks_df.schema).parquet(str(mark_path))
    out = processors.expand_periods(processors.period_input(facts, live), 10_000, "60 seconds")
    drain(out, queries.append_table(str(tmp_path / "out")), "periods", tmp_path)
    columns = ["container_id", "app_id", "ts", "name", "value", "tags"]
    assert rows(collected(spark, tmp_path / "out"), *columns) == rows(expected, *columns)


@pytest.mark.parametrize("scope", [[], ["app_id"]])
def test_gap_aware_windows(spark, tmp_path, rows, scope):
    ticks = [*range(1, 10), *range(15, 25)]
    schema = "app_id STRING, tick BIGINT, container_id STRING"
    data = [(app, t * 1000, f"c{c}") for app in ("a", "b") for t in ticks for c in range(2) if (app, t) != ("b", 20)]
    data.sort(key=lambda r: r[1])
    batches = [data[:20], data[20:50], data[50:], [("z", FAR * 1000, "c")]]
    spec = WindowSpec(3, 2, 1000)
    stream = as_stream(spark, tmp_path / "in", batches, schema)
    out = processors.gap_aware_stream(stream, spec, scope, "2 seconds")
    drain(out, queries.append_table(str(tmp_path / "out")), f"windows{len(scope)}", tmp_path)
    expected = windows.gap_aware(spark.createDataFrame(data, schema), spec, scope)
    columns = [*scope, "window_start", "n_ticks"]
    assert rows(collected(spark, tmp_path / "out"), *columns) == rows(expected.select(*columns).distinct())


def test_app_flush(spark, tmp_path, rows):
    schema = "app_id STRING, tick BIGINT, finished_at TIMESTAMP"
    batches = [
        [("a", 1000, None), ("b", 1000, None), ("a", None, at(2))],
        [("a", (int(T0.timestamp()) + 3) * 1000, None), ("b", (int(T0.timestamp()) + 5) * 1000, None)],
        [("z", (int(T0.timestamp()) + FAR) * 1000, None)],
    ]
    stream = as_stream(spark, tmp_path / "in", batches, schema)
    cells = stream.where("tick IS NOT NULL").select("app_id", "tick")
    finished = stream.where("finished_at IS NOT NULL").select("app_id", "finished_at")
    out = processors.app_flush_stream(cells, finished, 2000)
    drain(out, queries.append_table(str(tmp_path / "out")), "flush", tmp_path)
    assert rows(collected(spark, tmp_path / "out"), "app_id") == [("a",)]


def test_late_facts_are_dropped(spark, tmp_path, rows):
    batches = [[(at(0), "a"), (at(30), "a")], [(at(61), "a")], [(at(1), "late")], [(at(FAR), "z")]]
    stream = as_stream(spark, tmp_path / "in", batches, "ts TIMESTAMP, k STRING")
    out = queries.tick_counts(stream, "10 seconds", "5 seconds", ["k"])
    drain(out, queries.append_table(str(tmp_path / "out")), "late", tmp_path)
    assert rows(collected(spark, tmp_path / "out"), "tick", "k", "n") == [
        (at(0), "a", 1), (at(30), "a", 1), (at(60), "a", 1),
    ]


def test_late_rows_reach_a_table_of_their_own(spark, tmp_path, rows):
    batches = [[(at(50), "a"), (at(5), "first")], [(at(44), "kept"), (at(45), "kept"), (at(39), "late"), (at(90), "a")], [(None, "none"), (at(79), "late")], [(at(80), "kept")]]
    stream = as_stream(spark, tmp_path / "in", batches, "ts TIMESTAMP, k STRING")
    kept, late = (queries.append_table(str(tmp_path / n)) for n in ("kept", "late"))
    channel = queries.split_late(kept, late, 10_000, str(tmp_path / "marks"))
    drain(stream, channel, "split", tmp_path)
    channel(spark.createDataFrame(batches[1], "ts TIMESTAMP, k STRING"), 1)  # a repeated batch is split alike
    assert rows(collected(spark, tmp_path / "late"), "ts", "k") == [(at(39), "late"), (at(79), "late")]
    table = spark.createDataFrame([(*r, i) for i, b in enumerate(batches) for r in b], "ts TIMESTAMP, k STRING, batch INT")
    flagged = windows.flag_late(table, "batch", 10_000)
    assert rows(flagged.where("is_late"), "ts", "k") == rows(collected(spark, tmp_path / "late"), "ts", "k")
    assert rows(flagged.where("not is_late"), "ts", "k") == rows(collected(spark, tmp_path / "kept"), "ts", "k")


def test_idle_sessions(spark, tmp_path, rows):
    data = [(at(s), "a") for s in (0, 5, 8, 30, 38)]
    batches = [data[:3], data[3:], [(at(FAR), "z")]]
    stream = as_stream(spark, tmp_path / "in", batches, "ts TIMESTAMP, k STRING")
    drain(queries.idle_sessions(stream, ["k"]), queries.append_table(str(tmp_path / "out")), "idle", tmp_path)
    assert rows(collected(spark, tmp_path / "out"), "session_start", "n_rows") == [(at(0), 3), (at(30), 2)]
    batch = windows.idle_sessions(spark.createDataFrame(data, "ts TIMESTAMP, k STRING"), 9000, ["k"])
    assert rows(batch, "session_start", "n_rows") == [(at(0), 3), (at(30), 2)]


def test_fan_out_and_repeated_batch(spark, tmp_path, rows):
    df = spark.createDataFrame([(1,), (2,)], "x INT")
    left, right = queries.append_table(str(tmp_path / "l")), queries.append_table(str(tmp_path / "r"))
    both = queries.fan_out([left, right])
    both(df, 0)
    both(df, 0)
    both(df.where("x = 2"), 1)
    for side in ("l", "r"):
        assert rows(spark.read.parquet(str(tmp_path / side)), "x", "batch_id") == [(1, 0), (2, 0), (2, 1)]


def test_latency(spark, rows):
    probes = spark.createDataFrame([("1577836800000",), ("bad",)], "value STRING")
    out = queries.latency(probes, F.lit(at(1)))
    assert rows(out, "metric", "value", "latency_ms") == [("test", 1.0, 1000)]


def test_actions_see_all_windows(spark, tmp_path, rows):
    data = [(t, f"c{t}") for t in range(4)]
    stream = as_stream(spark, tmp_path / "in", [data[:2], data[2:]], "window_start BIGINT, container_id STRING")
    registry = actions.Registry(stream, str(tmp_path / "progress"))
    first = registry.register("one", queries.append_table(str(tmp_path / "one")), None)
    assert registry.register("one", queries.append_table(str(tmp_path / "never")), None) is first
    second = registry.register("two", queries.append_table(str(tmp_path / "two")), None)
    assert first.awaitTermination(120) and second.awaitTermination(120)
    for name in ("one", "two"):
        assert rows(collected(spark, tmp_path / name), "window_start", "container_id") == data
    assert not (tmp_path / "never").exists()
    registry.unregister("one")
    assert list(registry.running) == ["two"]


class Store:
    """State in memory, with the calls a processor makes."""

    def __init__(self):
        self.maps, self.values, self.timers = {}, {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return MapOf(self.maps.setdefault(name, {}))

    def getValueState(self, name, *_):  # noqa: N802
        return ValueOf(self.values, name)

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


class MapOf:
    def __init__(self, rows):
        self.rows = rows
        self.getValue, self.removeKey, self.clear = rows.__getitem__, rows.__delitem__, rows.clear
        self.updateValue = rows.__setitem__

    def containsKey(self, key):  # noqa: N802
        return key in self.rows

    def iterator(self):
        return iter(self.rows.items())


class ValueOf:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def update(self, value):
        self.values[self.name] = value


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_many_open_periods_and_a_long_leap_stay_within_bounds():
    import tracemalloc

    import pandas as pd

    periods_open, ticks = 100_000, 40
    processor, store = processors.PeriodProcessor(1000), Store()
    processor.init(store)
    columns = processors._COLUMNS
    for part in range(0, periods_open, 10_000):
        facts = [(1 + i, i, 0, 0, "start", "task", "period", "a", f'[{{"TID":"{i}"}}]', 1.0) for i in range(part, part + 10_000)]
        list(processor.handleInputRows(("c",), iter([pd.DataFrame(facts, columns=columns)]), Clock(0)))
    tracemalloc.start()
    rows, largest = 0, 0
    for frame in processor.handleExpiredTimer(("c",), Clock(ticks * 1000), None):
        rows, largest = rows + len(frame), max(largest, len(frame))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == periods_open * ticks and largest <= processors.ROWS_PER_FRAME
    assert len(store.maps["open"]) == periods_open and not store.maps["facts"] and not store.maps["steps"]
    assert peak < 200 << 20
    again = sum(len(f) for f in processor.handleExpiredTimer(("c",), Clock(ticks * 1000), None))
    assert again == 0
    finish = pd.DataFrame([(ticks * 1_000_000 + 1_500_000, 0, -1, -1, "container", None, None, None, None, None)], columns=columns)
    list(processor.handleInputRows(("c",), iter([finish]), Clock(ticks * 1000)))
    assert sum(len(f) for f in processor.handleExpiredTimer(("c",), Clock(ticks * 1000 + 5000), None)) == periods_open
    assert not store.maps["open"]


def test_open_periods_of_one_container_equal_the_batch(spark, tmp_path, rows):
    data = [fact("c1", str(i), 1 + i % 7, False, i) for i in range(3000)]
    ends = [fact("c1", str(i), 31 + i % 50, True, 10_000 + i) for i in range(0, 3000, 3)]
    marks = [("c1", at(95), 50_000)]
    facts = as_stream(spark, tmp_path / "in", [data, ends, [fact("far", "1", FAR, False, 99_999)]], FACTS)
    marks_df = spark.createDataFrame(marks, "container_id STRING, ts TIMESTAMP, seq BIGINT")
    marks_df.coalesce(1).write.parquet(str(tmp_path / "marks"))
    live = spark.readStream.schema(marks_df.schema).parquet(str(tmp_path / "marks"))
    out = processors.expand_periods(processors.period_input(facts, live, slots=3), 10_000, "60 seconds")
    drain(out, queries.append_table(str(tmp_path / "out")), "many", tmp_path)
    batch = spark.createDataFrame([*data, *ends], FACTS)
    expected = periods.expand(periods.pair(batch, marks_df), 10_000, F.lit(at(FAR - 1)))
    columns = ["container_id", "ts", "name", "value", "tags"]
    assert rows(collected(spark, tmp_path / "out"), *columns) == rows(expected, *columns)
