"""Metric samples: text parsing, unpivot, and rates from cumulative counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.functions import ids, scalars
from clusterlens.operators import segments

# Fixed field order of a metric line, after container and timestamp.
METRIC_FIELDS = (
    "cpu",
    "memory",
    "disk_service_byte",
    "disk_service_time",
    "disk_wait_time",
    "disk_io_time",
    "net_rx",
    "net_tx",
)
# Fixed names of the seven metrics and the cell column each one fills.
METRIC_COLUMNS = {
    "cpu": "cpu",
    "memory": "memory",
    "disk.service.byte": "disk_service_byte",
    "disk.service.time": "disk_service_time",
    "disk.wait.time": "disk_wait_time",
    "diskIOTime": "disk_io_time",
    "network": "net_rate",
}
MIN_FIELDS = 10


def parse_tags(fields: Column, base: Column) -> Column:
    """Tag map from `key:value` fields on top of `base`; a later key replaces an earlier one."""
    parts = F.transform(
        fields, lambda f: F.split(F.regexp_replace(f, ":+$", ""), ":")
    )
    pairs = F.filter(parts, lambda p: F.size(p) >= 2)
    return F.aggregate(
        pairs,
        base,
        lambda tags, p: F.map_concat(
            F.map_filter(tags, lambda k, v: k != p[0]), F.create_map(p[0], p[1])
        ),
    )


def _parsed(df: DataFrame, value: str) -> DataFrame:
    fields = F.split(F.col(value), ",")
    numbers = [
        F.try_element_at(fields, F.lit(i + 3)).try_cast("double").alias(name)
        for i, name in enumerate(METRIC_FIELDS)
    ]
    container = F.try_element_at(fields, F.lit(1))
    base = F.map_filter(
        F.create_map(
            F.lit("app"), ids.container_to_app(container), F.lit("container"), container
        ),
        lambda k, v: v.isNotNull(),
    )
    return df.select(
        "*",
        container.alias("container_id"),
        scalars.strict_timestamp(F.try_element_at(fields, F.lit(2))).alias("ts"),
        *numbers,
        F.when(
            F.size(fields) >= MIN_FIELDS, parse_tags(F.slice(fields, F.lit(10), F.size(fields)), base)
        ).alias("tags"),
    )


def _complete() -> Column:
    ok = F.col("ts").isNotNull() & F.col("tags").isNotNull()
    for name in METRIC_FIELDS:
        ok = ok & F.col(name).isNotNull()
    return ok


def parse_metric_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Typed samples with `net_rate = net_rx + net_tx`; malformed lines go to `rejected_lines`.

    Needs `seq` (arrival order).
    """
    return (
        _parsed(df, value)
        .where(_complete())
        .select("seq", "container_id", "ts", *METRIC_FIELDS, "tags")
        .withColumn("net_rate", F.col("net_rx") + F.col("net_tx"))
        .withColumn("app_id", F.col("tags")["app"])
    )


def rejected_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Lines with too few fields, a non-numeric field or a bad timestamp, as they came."""
    return _parsed(df, value).where(~_complete()).select(*[df[c] for c in df.columns])


def unpivot(samples: DataFrame) -> DataFrame:
    """Seven (metric, value) rows per sample."""
    pairs = [
        F.struct(F.lit(name).alias("metric"), F.col(column).alias("value"))
        for name, column in METRIC_COLUMNS.items()
    ]
    return samples.select(
        "seq", "container_id", "app_id", "ts", "tags", F.inline(F.array(*pairs))
    )


def _previous(df: DataFrame, key: str, order: str, columns: list[str], **cut) -> DataFrame:
    return segments.lag(
        df, [key], segments.micros(order), [order], {f"_prev_{c}": c for c in columns}, **cut
    )


def counter_ratio(
    df: DataFrame, num: str, den: str, key: str, order: str, out: str = "rate", **cut
) -> DataFrame:
    """max(0, change of `num` / change of `den`); 0.0 for the first sample of a key."""
    with_prev = _previous(df, key, order, [num, den], **cut)
    part = F.try_divide(
        (F.col(num) - F.col(f"_prev_{num}")).cast("double"),
        (F.col(den) - F.col(f"_prev_{den}")).cast("double"),
    )
    first = F.col(f"_prev_{num}").isNull()
    rate = F.when(first, 0.0).otherwise(F.greatest(F.lit(0.0), part))
    return with_prev.withColumn(out, rate).drop(f"_prev_{num}", f"_prev_{den}")


def counter_rate(
    df: DataFrame, columns: list[str], key: str, order: str, **cut
) -> DataFrame:
    """kB/s of cumulative byte counters, as `<column>_rate`; 0.0 for the first sample of a key."""
    with_prev = _previous(df, key, order, [order, *columns], **cut)
    seconds = (segments.micros(order) - segments.micros(f"_prev_{order}")) / F.lit(1_000_000.0)
    for c in columns:
        rate = F.try_divide(
            F.try_divide((F.col(c) - F.col(f"_prev_{c}")).cast("double"), seconds), F.lit(1000.0)
        )
        with_prev = with_prev.withColumn(
            f"{c}_rate", F.when(F.col(f"_prev_{order}").isNull(), 0.0).otherwise(rate)
        )
    return with_prev.drop(f"_prev_{order}", *[f"_prev_{c}" for c in columns])


def baseline(df: DataFrame, column: str, key: str, order: str, out: str, **cut) -> DataFrame:
    """Counter minus its first non-zero reading so far, hence 0 up to and including that reading."""
    df = segments.assign(df, [key], segments.micros(order), **cut)
    reading = F.nullif(F.col(column), F.lit(0))
    seen = F.when(reading.isNotNull(), F.col(order))
    handed = segments.carry(df, [key], _offset=(F.min_by(reading, seen), "first"))
    so_far = segments.inside([key], [order]).rowsBetween(Window.unboundedPreceding, 0)
    offset = F.coalesce("_offset", F.first(reading, ignorenulls=True).over(so_far), F.lit(0))
    return (
        segments.join_on(df, handed, [key, segments.SEGMENT], "left")
        .withColumn(out, F.col(column) - offset)
        .drop("_offset", segments.SEGMENT)
    )


def zero_fill_leading(
    samples: DataFrame,
    starts: DataFrame,
    columns: list[str],
    interval_ms: int = 1000,
    limit_ms: int = 10_000,
) -> DataFrame:
    """Prepend zero samples between a container's start and its first sample.

    One per interval from the start on, at most `limit_ms / interval_ms` of them, so none where the interval is
    longer than the limit. `starts` has one row per container (`container_id`, `ts`).
    """
    real = samples.select(
        "container_id", "ts", *[F.col(c).cast("double").alias(c) for c in columns], F.lit(False).alias("filled")
    )
    if interval_ms > limit_ms:
        return real
    first = samples.groupBy("container_id").agg(F.min("ts").alias("_first"))
    steps = F.sequence(F.lit(0), F.lit(limit_ms // interval_ms - 1))
    filled = (
        starts.select("container_id", F.col("ts").alias("_start"))
        .join(first, "container_id", "left")
        .select("container_id", "_start", "_first", F.explode(steps).alias("_step"))
        .withColumn(
            "ts", F.timestamp_micros(F.unix_micros("_start") + F.col("_step") * interval_ms * 1000)
        )
        .where(F.col("_first").isNull() | (F.col("ts") < F.col("_first")))
        .select("container_id", "ts", *[F.lit(0.0).alias(c) for c in columns], F.lit(True).alias("filled"))
    )
    return real.unionByName(filled)
