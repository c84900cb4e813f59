"""Start/finish pairing of period facts and their expansion onto a tick grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.functions.ids import tag_key, tags_of_key
from clusterlens.operators import segments
from clusterlens.operators.extract import INSTANT

ORDER = ["ts", "seq", "rule_id", "group_id"]
BY_FINISH = "finish"
BY_CONTAINER = "container_finish"
OPEN = "open"
TICKS_PER_CHUNK = 4096


def pair(messages: DataFrame, container_finish: DataFrame, **cut) -> DataFrame:
    """Periods of (container, name, tags): first start opens, first finish after it closes.

    `container_finish` (container_id, ts, seq) ends every open period of the container. Each start learns
    what closes it: the next finish of its own key or the next finish of its container, whichever comes
    first. Starts with the same closing event are one period, so a period is one aggregate row, and a
    marker is never copied to the keys of its container. One shuffle, by container, while no container is crowded
    (`segments`); a crowded one is cut by time. Give a stored table: it is scanned twice, and twice more for cuts.
    """
    facts = messages.where(F.col("type") != INSTANT).select(
        "container_id",
        "app_id",
        "name",
        "type",
        tag_key(F.col("tags")).alias("tag_key"),
        "value",
        "is_finish",
        *ORDER,
    )
    markers = container_finish.select(
        "container_id",
        "ts",
        "seq",
        F.lit(-1).alias("rule_id"),
        F.lit(-1).alias("group_id"),
    )
    keys = ["container_id", "name", "tag_key"]
    rows, several = segments.cut_crowded(
        facts.unionByName(markers, allowMissingColumns=True), ["container_id"], segments.micros(), **cut
    )
    at = F.struct(*ORDER)
    is_marker = F.col("name").isNull()
    is_close = F.col("is_finish")
    latest_first = [F.desc(c) for c in ORDER]
    from_here = (Window.unboundedPreceding, 0)
    by_container = segments.inside(["container_id"], latest_first).rowsBetween(*from_here)
    marker = F.min(F.when(is_marker, at)).over(by_container)
    finish = F.min(F.when(is_close, at))
    if several:
        next_marker = segments.carry(rows, ["container_id"], _marker=(F.min(F.when(is_marker, at)), "next"))
        next_finish = segments.carry(rows.where(~is_marker), keys, _finish=(finish, "next"))
        rows = segments.join_on(rows, next_marker, ["container_id", segments.SEGMENT], "left")
        rows = rows.withColumn("_marker", F.coalesce(marker, F.col("_marker"))).where(~is_marker)
        rows = segments.join_on(rows, next_finish, [*keys, segments.SEGMENT], "left")
        by_key = segments.inside(keys, latest_first).rowsBetween(*from_here)
        rows = rows.withColumn("_finish", F.coalesce(finish.over(by_key), F.col("_finish")))
    else:
        rows = rows.withColumn("_marker", marker).where(~is_marker)
        by_key = Window.partitionBy(*keys).orderBy(*latest_first).rowsBetween(*from_here)
        rows = rows.withColumn("_finish", finish.over(by_key))
    rows = rows.where(~is_close).withColumn("_close", F.least("_finish", "_marker"))
    opening = F.struct("ts", "value", "app_id", "type")
    by_own_finish = F.col("_close") == F.col("_finish")
    closed_by = (
        F.when(F.col("_close").isNull(), OPEN).when(by_own_finish, BY_FINISH).otherwise(BY_CONTAINER)
    )
    return (
        rows.withColumn("closed_by", closed_by)
        .groupBy(*keys, "_close", "closed_by")
        .agg(F.min_by(opening, at).alias("_open"))
        .select(
            "container_id",
            "_open.app_id",
            "name",
            "_open.type",
            "tag_key",
            tags_of_key(F.col("tag_key")).alias("tags"),
            "_open.value",
            F.col("_open.ts").alias("start_ts"),
            F.col("_close.ts").alias("end_ts"),
            "closed_by",
        )
    )


def _grid_from(us: Column, size: int) -> Column:
    """Number of the first grid tick at or after an instant."""
    return ((us + F.pmod(-us, F.lit(size))) / size).cast("bigint")


def expand(periods: DataFrame, tick_ms: int, horizon: Column) -> DataFrame:
    """One fact per grid tick of each period, with the start's value.

    A finished period that meets no tick is still emitted once; one ended by its container is not. An
    open one runs up to `horizon` (TIMESTAMP). Long periods expand chunk by chunk, so no row ever holds
    an unbounded list of ticks.
    """
    tick_us = tick_ms * 1000
    start = F.unix_micros("start_ts")
    end = F.unix_micros("end_ts")
    lo = _grid_from(start, tick_us)
    last_before_end = _grid_from(end, tick_us) - 1
    now = F.unix_micros(horizon)
    hi = (
        F.when(F.col("closed_by") == BY_FINISH, F.greatest(lo, last_before_end))
        .when(F.col("closed_by") == BY_CONTAINER, last_before_end)
        .otherwise(((now - F.pmod(now, F.lit(tick_us))) / tick_us).cast("bigint"))
    )
    size = F.lit(TICKS_PER_CHUNK)
    chunked = (
        periods.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .where(F.col("_hi") >= F.col("_lo"))
        .withColumn("_from", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), size.cast("bigint"))))
        .withColumn("_to", F.least(F.col("_hi"), F.col("_from") + size - 1))
    )
    return chunked.withColumn("_tick", F.explode(F.sequence("_from", "_to"))).select(
        "container_id",
        "app_id",
        F.timestamp_micros(F.col("_tick") * tick_us).alias("ts"),
        "type",
        "name",
        "tags",
        "value",
    )
