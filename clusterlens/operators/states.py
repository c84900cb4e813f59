"""State timelines, as-of lookups, live values and finished applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.functions import scalars, states
from clusterlens.operators import segments

DEFAULT_STATE = "NEW"
# Fixed forms of the daemon lines that carry a container's state.
START_REQUEST = r".*Start request for (container\S*).*"
TRANSITION = r".*Container (\S+) transitioned from.* to (\S+)\s*"


def state_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Timeline rows (container_id, state, ts, seq) of the daemon lines that report a state."""
    text = F.col(line)
    starts = F.contains(text, F.lit("Start request for container"))
    moves = F.contains(text, F.lit(" transitioned from"))
    found = F.when(
        starts,
        F.struct(
            F.regexp_extract(text, START_REQUEST, 1).alias("container_id"),
            F.lit(DEFAULT_STATE).alias("state"),
        ),
    ).otherwise(
        F.struct(
            F.regexp_extract(text, TRANSITION, 1).alias("container_id"),
            F.regexp_extract(text, TRANSITION, 2).alias("state"),
        )
    )
    return (
        lines.where(starts | moves)
        .select(found.alias("_f"), scalars.parse_log_ts(text).alias("ts"), "seq")
        .select("_f.container_id", "_f.state", "ts", "seq")
        .where((F.col("container_id") != "") & F.col("ts").isNotNull())
    )


def state_as_of(
    probes: DataFrame, events: DataFrame, key: str = "container_id", **cut
) -> DataFrame:
    """Add `state`: the container's last state at or before each probe's `ts`, else NEW."""
    columns = probes.columns
    both = probes.withColumn("_is_probe", F.lit(1)).unionByName(
        events.select(key, "ts", "seq", F.col("state").alias("_state"), F.lit(0).alias("_is_probe")),
        allowMissingColumns=True,
    )
    filled = segments.fill(
        both,
        [key],
        segments.micros(),
        ["ts", "_is_probe", "seq"],
        F.when(F.col("_is_probe") == 0, F.col("_state")),
        "state",
        **cut,
    )
    return filled.where(F.col("_is_probe") == 1).select(
        *columns, F.coalesce("state", F.lit(DEFAULT_STATE)).alias("state")
    )


def live_value(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", "_")


def live_info(messages: DataFrame, as_of: Column | None = None, **cut) -> DataFrame:
    """Current value per (container, name): `info` is `name:value`, `ts` the last change.

    Needs container_id, name, value_text, is_finish, ts, seq. A finish removes the value.
    """
    rows = messages if as_of is None else messages.where(F.col("ts") <= as_of)
    rows = rows.withColumn("_value", F.when(~F.col("is_finish"), live_value(F.col("value_text"))))
    keys, order = ["container_id", "name"], ["ts", "seq"]
    rows = segments.lag(
        rows, keys, segments.micros(), order, {"_before": "_value"}, **cut
    )
    changed = ~F.col("_value").eqNullSafe(F.col("_before"))
    return (
        rows.groupBy(*keys)
        .agg(
            F.max_by(F.struct("_value"), F.struct(*order)).alias("_now"),
            F.max(F.when(changed, F.col("ts"))).alias("ts"),
        )
        .where(F.col("_now._value").isNotNull())
        .select(
            *keys,
            F.col("_now._value").alias("value"),
            F.concat_ws(":", "name", "_now._value").alias("info"),
            "ts",
        )
    )


def finished_apps(messages: DataFrame) -> DataFrame:
    """Applications whose state code says they are over, with the first time it did."""
    over = (
        (F.col("type") == "instant")
        & (F.col("name") == "app.state")
        & (F.col("value") > states.APP_FINISHED_ABOVE)
    )
    return (
        messages.where(over)
        .groupBy(F.col("tags")["app"].alias("app_id"))
        .agg(F.min("ts").alias("finished_at"))
    )
