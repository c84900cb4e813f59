"""Cells: what one container reported in one tick, metrics and messages side by side.

The long forms (`metric_cells`, `cell_messages`) are the working tables: one row per cell, and one row per
message. Nested message maps exist for snapshots only, on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.operators import segments
from clusterlens.operators.extract import INSTANT, PERIOD
from clusterlens.operators.metrics import METRIC_COLUMNS
from clusterlens.operators.windows import tick
from clusterlens.session import stage

CELL = ["tick", "container_id"]


def _known(c: Column) -> Column:
    return c.isNotNull() & (c != "null")


def valid_container(points: DataFrame) -> DataFrame:
    return points.where(_known(F.col("container_id")))


def container_or_app(messages: DataFrame) -> DataFrame:
    """Facts without a container belong to their application; facts with neither are dropped."""
    c = F.col("container_id")
    return messages.withColumn(
        "container_id", F.when(_known(c), c).otherwise(F.col("app_id"))
    ).where(F.col("container_id").isNotNull())


def identifiers(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin("container", "app"))


def metric_cells(points: DataFrame, tick_ms: int) -> DataFrame:
    """Seven metric columns per cell from (metric, value) points; the last write wins, default 0.0."""
    rows = valid_container(points).withColumn("tick", tick(F.unix_millis("ts"), tick_ms))
    return rows.groupBy(*CELL).agg(
        F.max_by("app_id", F.when(F.col("app_id").isNotNull(), F.col("seq"))).alias("app_id"),
        *[
            F.coalesce(
                F.max_by("value", F.when(F.col("metric") == name, F.col("seq"))), F.lit(0.0)
            ).alias(column)
            for name, column in METRIC_COLUMNS.items()
        ],
    )


def sample_cells(samples: DataFrame, tick_ms: int) -> DataFrame:
    """`metric_cells` straight from whole samples: each writes all seven, so no unpivot is needed."""
    rows = valid_container(samples).withColumn("tick", tick(F.unix_millis("ts"), tick_ms))
    columns = list(METRIC_COLUMNS.values())
    return (
        rows.groupBy(*CELL)
        .agg(
            F.max_by(F.struct(*columns), "seq").alias("_m"),
            F.max_by("app_id", F.when(F.col("app_id").isNotNull(), F.col("seq"))).alias("app_id"),
        )
        .select(*CELL, "app_id", "_m.*")
    )


def cell_messages(messages: DataFrame, tick_ms: int) -> DataFrame:
    """Facts by cell in long form; `kind` says in which of the two message maps a fact belongs.

    A fact without a type makes a cell but is no message: its `kind` is null.
    """
    return container_or_app(messages).select(
        tick(F.unix_millis("ts"), tick_ms).alias("tick"),
        "container_id",
        "app_id",
        F.when(F.col("type") == PERIOD, PERIOD)
        .when(F.col("type").isNotNull(), INSTANT)
        .alias("kind"),
        F.col("name").alias("key"),
        identifiers(F.col("tags")).alias("identifiers"),
        "value",
        "seq",
    )


def message_counts(long: DataFrame) -> DataFrame:
    """Number and sum of messages per (cell, kind, key)."""
    return long.where(F.col("kind").isNotNull()).groupBy(*CELL, "kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )


def build(samples: DataFrame, messages: DataFrame, tick_ms: int) -> DataFrame:
    """All cells: one exists when either side reports in the tick.

    Samples and facts are stacked and meet in a single aggregate on the cell, combined map-side, so this
    full outer alignment costs one shuffle. `seq` orders the arrivals of both sides.
    """
    columns = list(METRIC_COLUMNS.values())
    left = valid_container(samples).select(
        tick(F.unix_millis("ts"), tick_ms).alias("tick"),
        "container_id",
        "app_id",
        "seq",
        F.struct(*columns).alias("_m"),
    )
    right = cell_messages(messages, tick_ms).select(*CELL, "app_id", "seq", "kind")
    sides = left.unionByName(right, allowMissingColumns=True)
    is_sample = F.col("_m").isNotNull()
    merged = sides.groupBy(*CELL).agg(
        F.max_by("_m", F.when(is_sample, F.col("seq"))).alias("_m"),
        F.max_by("app_id", F.when(F.col("app_id").isNotNull(), F.col("seq"))).alias("app_id"),
        F.count("kind").alias("n_messages"),
    )
    return merged.select(
        *CELL,
        "app_id",
        *[F.coalesce(F.col("_m")[c], F.lit(0.0)).alias(c) for c in columns],
        F.col("_m").isNotNull().alias("has_metrics"),
        "n_messages",
    )


def _by_arrival(a: Column, b: Column) -> Column:
    return (
        F.when(a["seq"] < b["seq"], -1)
        .when(a["seq"] > b["seq"], 1)
        .when(a["_ident"] < b["_ident"], -1)
        .when(a["_ident"] > b["_ident"], 1)
        .otherwise(0)
    )


def message_maps(long: DataFrame) -> DataFrame:
    """Period and instant maps (key -> list of messages in order of arrival), one row per cell that has messages.

    A list holds all messages of its cell and key, so ask for maps only where a snapshot in the nested form is
    wanted; the table of messages is the form that grows without bound.
    """
    message = F.struct("key", "identifiers", "value").alias("m")
    per_key = (
        long.where(F.col("kind").isNotNull())
        .withColumn("_ident", F.to_json(F.map_entries("identifiers")))
        .groupBy(*CELL, "kind", "key")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "_ident", message)), _by_arrival).alias("_list"))
        .withColumn("_list", F.transform("_list", lambda x: x["m"]))
    )
    per_kind = {
        kind: F.map_from_entries(
            F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "_list")))
        ).alias(f"{kind}_messages")
        for kind in ("period", "instant")
    }
    return per_key.groupBy(*CELL).agg(*per_kind.values())


def nested(cells: DataFrame, maps: DataFrame) -> DataFrame:
    """Cells with their message maps, the form snapshots are written in: one row per cell."""
    return segments.join_on(cells.drop("n_messages", "has_metrics"), maps, CELL, "left")


def active_containers(cells: DataFrame) -> DataFrame:
    """Containers per tick, at the ticks where their number changes."""
    per_tick = stage(
        cells.select(*CELL).distinct().groupBy("tick").agg(F.count(F.lit(1)).alias("containers"))
    )
    changes = segments.lag(
        per_tick,
        [],
        F.col("tick"),
        ["tick"],
        {"_before": "containers"},
    )
    return changes.where(~F.col("containers").eqNullSafe(F.col("_before"))).drop("_before")
