"""The live path against its batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clusterlens.operators import cells, extract, windows
from clusterlens.operators.windows import WindowSpec
from clusterlens.plans import flows
from clusterlens.sinks import snapshots
from clusterlens.sources import bundled, logs
from clusterlens.streaming import live, queries

T0 = datetime(2020, 1, 1)
FAR = 500_000
RECORDS = "key STRING, value STRING, seq BIGINT"
TICK = 10_000


def stamp(second):
    return (T0 + timedelta(seconds=second)).strftime("%Y-%m-%d %H:%M:%S.%f")[:23]


def container(n):
    return f"container_15_000{n % 2 + 1}_01_{n:06d}"


def metric(n, second, value, seq):
    line = f"{container(n)},{stamp(second)},{value},{value * 2},3,4,5,6,7,8"
    return (f"{container(n)}-metric", line, seq)


def task(n, second, tid, seq, done=False):
    text = f"Finished task 1.0 in stage 0.0 (TID {tid}). 77 bytes result sent to driver" if done else f"Running task 1.0 in stage 0.0 (TID {tid})"
    return (f"{container(n)}-log", f"{container(n)} {stamp(second + 7200)} INFO Executor: {text}", seq)


def all_records():
    rng = random.Random(2)
    rows = []
    for second in [*range(0, 60, 3), *range(200, 260, 4)]:
        for n in range(2, 6):
            kind = rng.random()
            seq = len(rows)
            if kind < 0.5:
                rows.append(metric(n, second, rng.randint(1, 9), seq))
            elif kind < 0.9:
                rows.append(task(n, second, rng.randint(1, 4), seq, rng.random() < 0.4))
    rows.append(("other", "x", len(rows)))
    rows.append((f"{container(3)}-metric", "broken", len(rows)))
    return rows


def stream_of(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def batch_cells(spark, records):
    routed = extract.route(spark.createDataFrame(records, RECORDS))
    samples, facts = flows.samples(routed), flows.facts(routed, bundled.DEFAULT)
    built = cells.build(samples, facts, TICK)
    maps = cells.message_maps(cells.cell_messages(facts, TICK))
    return built.join(maps, cells.CELL, "left")


def told(df):
    """Rows of cells in a form that compares: maps as sorted pairs."""
    columns = [c for c in df.columns if c not in ("period_messages", "instant_messages", "closed_at")]
    maps = [F.to_json(F.array_sort(F.map_entries(F.transform_values(f"{k}_messages", lambda _, v: F.to_json(v))))).alias(k) for k in ("period", "instant")]
    return sorted(map(str, df.select(*sorted(columns), *maps).collect()))


def collected(spark, path):
    return spark.read.option("recursiveFileLookup", "true").parquet(str(path))


def test_live_cells_equal_built_cells(spark, tmp_path):
    records = all_records()
    parts = [records[:30], records[30:31], records[31:], [metric(9, FAR, 1, 10_000)]]
    out = flows.live_cells(stream_of(spark, tmp_path / "in", parts, RECORDS), bundled.DEFAULT, TICK, "20 seconds")
    query = queries.start(out, queries.append_table(str(tmp_path / "out")), "cells", str(tmp_path / "progress"), None)
    assert query.awaitTermination(300)
    want = batch_cells(spark, records)
    assert want.where("has_metrics and n_messages > 0").count() > 3 < want.where("not has_metrics").count()
    assert told(collected(spark, tmp_path / "out")) == told(want)


@pytest.mark.parametrize("scope", [[], ["app_id"]])
def test_live_windows_hold_their_cells(spark, tmp_path, scope):
    schema = "app_id STRING, tick BIGINT, container_id STRING, memory DOUBLE, messages MAP<STRING, ARRAY<DOUBLE>>"
    ticks = [*range(1, 10), *range(15, 25)]
    data = [
        (app, t * 1000, f"{app}{c}", t + c / 4, {"k": [float(t), 0.1]} if c else None)
        for t in ticks for app in ("a", "b") for c in range(3) if (app, t) != ("b", 20) and (c, t % 3) != (1, 0)
    ]
    parts = [data[:20], data[20:50], data[50:], [("z", FAR * 1000, "c", 0.0, None)]]
    spec = WindowSpec(4, 2, 1000)
    out = live.windowed(stream_of(spark, tmp_path / "in", parts, schema), spec, scope, "2 seconds", slots=3)
    query = queries.start(out, queries.append_table(str(tmp_path / "out")), f"w{len(scope)}", str(tmp_path / "progress"), None)
    assert query.awaitTermination(300)
    want = windows.windowed(spark.createDataFrame(data, schema), spec, scope)
    columns = ["app_id", "tick", "container_id", "memory", "messages", "window_start", "n_ticks"]
    got, expected = (sorted(map(str, df.select(*columns).collect())) for df in (collected(spark, tmp_path / "out"), want))
    assert got == expected and len(got) > len(data)
    # what has slid out is gone: the far sentinel and its marks are all that is left in the store of windows
    states = [op for p in query.recentProgress[-1:] for op in p["stateOperators"] if op["operatorName"].startswith("transformWithState")]
    assert states and all(op["numRowsTotal"] < 40 for op in states)


def test_detection_from_records_to_actions(spark, tmp_path):
    records = all_records()
    parts = [records[:25], records[25:60], records[60:], [metric(9, FAR, 1, 10_000)], [metric(9, 2 * FAR, 1, 10_001)]]
    spec = WindowSpec(3, 2, TICK)
    stream = flows.live_cells(stream_of(spark, tmp_path / "in", parts, RECORDS), bundled.DEFAULT, TICK)
    with pytest.raises(ValueError):
        flows.run(spark, "detection", str(tmp_path / "d"), spec, stream)
    run = flows.run(spark, "detection", str(tmp_path / "d"), spec, stream, checkpoints=str(tmp_path / "progress"), trigger=None)
    for name in ("one", "two"):
        run.actions.register(name, queries.append_table(str(tmp_path / name)))
    run.drain()
    want = windows.windowed(batch_cells(spark, records), spec)
    for name in ("one", "two"):
        got = collected(spark, tmp_path / name).where(F.col("tick") < (T0.timestamp() + FAR - 100) * 1000)
        assert told(got) == told(want)
    run.stop()


def test_training_reads_both_snapshot_forms(spark, tmp_path):
    records = all_records()
    table = batch_cells(spark, records).drop("has_metrics", "n_messages")
    spec, path = WindowSpec(3, 2, TICK), str(tmp_path / "store")
    early, late = table.where(F.col("tick") < T0.timestamp() * 1000 + 100_000), table.where(F.col("tick") >= T0.timestamp() * 1000 + 30_000)
    assert flows.run(spark, "storage", path, spec, early, fmt="json").endswith("sliding_window0")
    assert flows.run(spark, "storage", path, spec, late, fmt="parquet").endswith("sliding_window1")
    assert logs.read_store(spark, path).select("source").distinct().count() >= 2
    assert told(flows.run(spark, "training", path, spec)) == told(windows.windowed(table, spec))
    assert snapshots.next_snapshot(spark, path) == 2
