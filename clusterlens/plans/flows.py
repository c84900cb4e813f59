"""End-to-end flows: keyed records to facts, cells, windows and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.operators import cells, extract, features, metrics, periods, windows
from clusterlens.operators.windows import WindowSpec
from clusterlens.sinks import snapshots
from clusterlens.sources import logs
from clusterlens.sources.rules import RuleSet
from clusterlens.streaming import live

MODES = ("storage", "training", "detection")


def samples(routed: DataFrame) -> DataFrame:
    return metrics.parse_metric_lines(routed.where(F.col("route") == "metric").select("seq", "value"))


def facts(routed: DataFrame, rules: RuleSet) -> DataFrame:
    """Facts of container and daemon logs from routed records (key, value, seq, route), read once."""
    return extract.apply_rule_set(extract.role_lines(routed), rules)


def live_cells(records: DataFrame, rules: RuleSet, tick_ms: int, lateness: str = "1 second") -> DataFrame:
    """Cells of a stream of keyed records (key, value, seq), as they are consumed: `live.cells` of its samples and facts."""
    routed = extract.route(records)
    return live.cells(samples(routed), facts(routed, rules), tick_ms, lateness)


def emitted(messages: DataFrame, finishes: DataFrame, tick_ms: int, horizon: Column) -> DataFrame:
    """What reaches the outputs: instant facts as they are, periods once per tick."""
    instant = messages.where(F.col("type") == extract.INSTANT)
    paired = periods.pair(messages, finishes)
    ticks = periods.expand(paired, tick_ms, horizon).withColumn("seq", F.unix_micros("ts"))
    columns = ["container_id", "app_id", "ts", "type", "name", "tags", "value", "seq"]
    return instant.select(*columns).unionByName(ticks.select(*columns))


def flushable_apps(
    cell_table: DataFrame, finished: DataFrame, quiet_ms: int, horizon_ms: Column
) -> DataFrame:
    """Finished applications that got no new tick for `quiet_ms` before the horizon."""
    last = cell_table.groupBy("app_id").agg(F.max("tick").alias("last_tick"))
    return (
        last.join(finished.select("app_id", F.unix_millis("finished_at").alias("finished_ms")), "app_id")
        .withColumn("last_tick", F.greatest("last_tick", "finished_ms"))
        .where(F.col("last_tick") + quiet_ms <= horizon_ms)
        .select("app_id", "last_tick")
    )


def run(
    spark: SparkSession,
    mode: str,
    path: str,
    spec: WindowSpec,
    nested_cells: DataFrame | None = None,
    fmt: str = "parquet",
    checkpoints: str | None = None,
    trigger: str | None = "1 second",
    scope: Sequence[str] = (),
) -> DataFrame | str | live.Detection | None:
    """`storage` writes cells as the next snapshot, in either format. `training` cuts windows over all stored snapshots
    of both formats. `detection` cuts windows over the given cells: live where they are a stream (`live.detect`), with
    actions to be registered on the result; at once where they are a table.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "storage":
        return snapshots.write_snapshot(nested_cells, path, fmt)
    if mode == "detection" and nested_cells.isStreaming:
        if checkpoints is None:
            raise ValueError("a live detection needs a checkpoint folder")
        return live.detect(spark, nested_cells, path, spec, checkpoints, scope, trigger=trigger)
    if mode == "detection":
        return windows.windowed(nested_cells, spec, scope)
    stored = logs.read_store(spark, path)
    merged = logs.merge_snapshots(stored, logs.snapshot_number(F.col("source"))).drop("source")
    return windows.windowed(merged, spec, scope)


def tasks_against_memory(
    cell_table: DataFrame, long: DataFrame, size: int = 6, stride: int = 5, **cut
) -> DataFrame:
    """Training set of the standard model: number of running tasks against peak memory."""
    series = features.aligned_series(cell_table, long, "memory", "task", "count")
    return features.training_set(series.withColumn("source", F.lit("store")), size, stride, **cut)


def cell_tables(
    metric_samples: DataFrame, facts_out: DataFrame, tick_ms: int
) -> tuple[DataFrame, DataFrame]:
    """The two working tables of a tick length: cells, and messages by cell."""
    return (
        cells.build(metric_samples, facts_out, tick_ms),
        cells.cell_messages(facts_out, tick_ms),
    )
