"""Ordered operators per key that never put a crowded key into one task.

A window function partitioned by a container alone sends all rows of that container to one task. That is right for
most containers and wrong for a hot one. So one small aggregate counts the rows of each key; where a key has more than
`split_rows`, its series is cut into segments of time. Windows run inside (key, segment), and what one needs from other
segments comes from a summary with one row per (key, segment), itself built by a map-side combined aggregate. Where no key is
crowded there is one segment per key and no summary, and an operator is one shuffle. A table of more than `WHOLE_ROWS` rows is
dealt by key and segment to as many tasks as hold about `TASK_ROWS` each, so what a task sorts does not grow with the table.

Each operator reads its input for the count as well, so give it a stored table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.session import stage

SEGMENT = "_segment"
SPLIT_ROWS = 200_000
TASK_ROWS = 100_000
WHOLE_ROWS = 500_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null is a value like any other, as it is to groups and windows."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, reduce(and_, same), how).drop(*[f"_right_{k}" for k in keys])


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts))


def deal(df: DataFrame, keys: Sequence[str | Column], rows: int, task_rows: int | None = None) -> DataFrame:
    """Rows of equal keys in one task, about `task_rows` (`TASK_ROWS`) in each; a small table is left to the optimizer.

    Partitions that adapt to bytes can hold millions of narrow rows, which take far more memory where they are sorted.
    """
    if rows <= WHOLE_ROWS:
        return df
    return df.repartition(max(math.ceil(rows / (task_rows or TASK_ROWS)), df.sparkSession.sparkContext.defaultParallelism), *keys)


def assign(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    width: int | None = None,
    split_rows: int | None = None,
    minor: str | None = None,
) -> DataFrame:
    """Add the segment (start on the axis) of each row; `axis` is the BIGINT leading sort key."""
    return cut_crowded(df, keys, axis, width, split_rows, minor)[0]


def cut_crowded(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    width: int | None = None,
    split_rows: int | None = None,
    minor: str | None = None,
) -> tuple[DataFrame, bool]:
    """`assign`, and whether any key has more than one segment.

    A key starts as one segment, or with `width` as a grid of that width. One small aggregate finds those with
    more than `split_rows` rows; they are cut into equal stretches, and again while a burst keeps one
    crowded, down to rows of one and the same instant. There are at most rows / split_rows of them, and
    the list is stored, so that the optimizer knows its size when it chooses the join.

    `minor` names a STRING column that orders rows of one instant. An instant that is crowded is then cut by prefixes of
    it, each as long as it takes, and the segment is a pair (start on the axis, prefix).
    """
    return _cut(df, keys, axis, width, split_rows, minor)[:2]


def _cut(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    width: int | None = None,
    split_rows: int | None = None,
    minor: str | None = None,
) -> tuple[DataFrame, bool, int]:
    """`cut_crowded`, and the number of rows."""
    at = F.col("_axis")
    split_rows = split_rows or SPLIT_ROWS
    cut = width is not None
    grid = at - F.pmod(at, F.lit(width)) if cut else F.lit(0).cast("bigint")
    df = df.withColumn("_axis", axis).withColumn(SEGMENT, grid)
    while True:
        sizes = df.groupBy(*keys, SEGMENT).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        too_many = (F.col("_n") > split_rows) & (F.col("_hi") > F.col("_lo"))
        found = sizes.agg(F.sum("_n").alias("rows"), F.max(too_many).alias("crowded")).first()
        crowded = (
            sizes.where(too_many)
            .withColumn("_pieces", F.ceil(F.col("_n") / F.lit(split_rows)))
            .withColumn("_step", F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.col("_pieces")))
            .select(*keys, SEGMENT, "_lo", "_step")
        )
        if not found["crowded"]:
            if minor is not None:
                df, again = _cut_instants(df, keys, split_rows, minor)
                cut = cut or again
            return df.drop("_axis"), cut, found["rows"] or 0
        cut = True
        finer = at - F.pmod(at - F.col("_lo"), F.col("_step"))
        df = (
            join_on(df, stage(crowded), [*keys, SEGMENT], "left")
            .withColumn(SEGMENT, F.coalesce(finer, F.col(SEGMENT)))
            .drop("_lo", "_step")
        )


def _cut_instants(df: DataFrame, keys: Sequence[str], split_rows: int, minor: str) -> tuple[DataFrame, bool]:
    """Cut crowded segments of one instant by prefixes of `minor`, which keep its order.

    All rows of a crowded piece share what its least and greatest text share, so one character more parts them.
    """
    text = F.coalesce(F.col(minor), F.lit(""))
    df = df.withColumn(SEGMENT, F.struct(F.col(SEGMENT).alias("start"), F.lit("").alias("prefix")))
    cut = False
    while True:
        shortest = F.least(F.length("_lo"), F.length("_hi"))
        alike = F.filter(F.sequence(F.lit(1), shortest), lambda n: F.left("_lo", n) == F.left("_hi", n))
        crowded = (
            df.groupBy(*keys, SEGMENT)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(text).alias("_lo"), F.max(text).alias("_hi"))
            .where((F.col("_n") > split_rows) & (F.col("_hi") > F.col("_lo")))
            .select(*keys, SEGMENT, (F.when(shortest > 0, F.size(alike)).otherwise(0) + 1).alias("_length"))
        )
        if crowded.isEmpty():
            return df, cut
        cut = True
        longer = F.struct(F.col(SEGMENT)["start"].alias("start"), F.left(text, F.col("_length")).alias("prefix"))
        df = (
            join_on(df, stage(crowded), [*keys, SEGMENT], "left")
            .withColumn(SEGMENT, F.when(F.col("_length").isNotNull(), longer).otherwise(F.col(SEGMENT)))
            .drop("_length")
        )


def _key_window(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def inside(keys: Sequence[str], order: Sequence[str | Column]):
    """Window over one segment of one key."""
    return Window.partitionBy(*keys, SEGMENT).orderBy(*order)


def carry(df: DataFrame, keys: Sequence[str], **values: tuple[Column, str]) -> DataFrame:
    """Per (key, segment): what the segments before (or after) hand over.

    Each value is `(aggregate of one segment, how)`, `how` being `last` (latest non-null of the segments
    before), `first` (earliest non-null of the segments before), `sum` (over the segments before), `next` (earliest non-null of the segments after) or
    `total` (sum over all segments).
    """
    one = df.groupBy(*keys, SEGMENT).agg(*[agg.alias(name) for name, (agg, _) in values.items()])
    ahead = _key_window(keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    back = _key_window(keys).orderBy(F.desc(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    pick = {
        "last": lambda c: F.last(c, ignorenulls=True).over(ahead),
        "first": lambda c: F.first(c, ignorenulls=True).over(ahead),
        "next": lambda c: F.last(c, ignorenulls=True).over(back),
        "sum": lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0)),
        "total": lambda c: F.sum(c).over(_key_window(keys)),
    }
    return one.select(
        *keys, SEGMENT, *[pick[how](F.col(name)).alias(name) for name, (_, how) in values.items()]
    )


def lag(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    order: Sequence[str],
    columns: dict[str, str],
    **cut,
) -> DataFrame:
    """Add the previous row's values: `columns` maps new name -> source column; null on the first row."""
    df, several, rows = _cut(df, keys, axis, **cut)
    row = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    local = deal(df, [*keys, SEGMENT], rows).withColumn("_prev", F.lag(row).over(inside(keys, order)))
    if not several:
        return local.select("*", "_prev.*").drop("_prev", SEGMENT)
    handed = carry(df, keys, _handed=(F.max_by(row, F.struct(*order)), "last"))
    return (
        join_on(local, handed, [*keys, SEGMENT], "left")
        .withColumn("_prev", F.coalesce("_prev", "_handed"))
        .select("*", "_prev.*")
        .drop("_prev", "_handed", SEGMENT)
    )


def fill(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    order: Sequence[str],
    value: Column,
    name: str,
    forward: bool = False,
    **cut,
) -> DataFrame:
    """Add the latest non-null `value` up to and including each row (or the earliest from it on)."""
    df, several, rows = _cut(df, keys, axis, **cut)
    df = df.withColumn("_value", value)
    window = inside(keys, [F.desc(c) for c in order] if forward else order)
    here = F.last("_value", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    local = deal(df, [*keys, SEGMENT], rows).withColumn(name, here)
    if not several:
        return local.drop("_value", SEGMENT)
    rank = F.when(F.col("_value").isNotNull(), F.struct(*order))
    pick, how = (F.min_by, "next") if forward else (F.max_by, "last")
    handed = carry(df, keys, _handed=(pick(F.col("_value"), rank), how))
    return (
        join_on(local, handed, [*keys, SEGMENT], "left")
        .withColumn(name, F.coalesce(name, "_handed"))
        .drop("_value", "_handed", SEGMENT)
    )


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    order: Sequence[str],
    flag: Column,
    name: str,
    total: str | None = None,
    **cut,
) -> DataFrame:
    """Add the number of earlier rows of the key with `flag`; optionally the key's total as well."""
    df, several, rows = _cut(df, keys, axis, **cut)
    df = df.withColumn("_flag", flag.cast("bigint"))
    window = inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum("_flag").over(window), F.lit(0))
    local = deal(df, [*keys, SEGMENT], rows).withColumn(name, here)
    if not several:
        if total:  # after the count, whose order serves it
            local = local.withColumn(total, F.sum("_flag").over(Window.partitionBy(*keys, SEGMENT)))
        return local.drop("_flag", SEGMENT)
    values = {"_before": (F.sum("_flag"), "sum")}
    if total:
        values[total] = (F.sum("_flag"), "total")
    return (
        join_on(local, carry(df, keys, **values), [*keys, SEGMENT], "left")
        .withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_flag", "_before", SEGMENT)
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    max_gap: int,
    until: str | None = None,
    width: int | None = None,
    split_rows: int | None = None,
) -> DataFrame:
    """Add first and last axis value of the run each row is in; steps above `max_gap` end a run.

    With `until` a row stands for the stretch from `axis` to `until`; stretches of a key do not overlap.
    """
    at = F.col(axis)
    end = F.col(until or axis)
    df, several, rows = _cut(df, keys, at, width, split_rows)
    df = deal(df, [*keys, SEGMENT], rows)
    ordered = inside(keys, [axis])
    backward = inside(keys, [F.desc(axis)])
    before, after = F.lag(end).over(ordered), F.lead(at).over(ordered)
    local = df.withColumn("_opens", F.when(at - before > max_gap, at)).withColumn(
        "_closes", F.when(after - end > max_gap, end)
    )
    # Range frames: rows with the same axis value are peers and must agree in both directions.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    opened_here, closed_here = F.max("_opens").over(ordered.rangeBetween(*so_far)), F.min("_closes").over(backward.rangeBetween(*so_far))
    if not several:
        whole = Window.partitionBy(*keys, SEGMENT)
        return (
            local.withColumn("island_start", F.coalesce(opened_here, F.min(at).over(whole)))
            .withColumn("island_end", F.coalesce(closed_here, F.max(end).over(whole)))
            .drop("_opens", "_closes", SEGMENT)
        )
    one = local.groupBy(*keys, SEGMENT).agg(
        F.min(at).alias("_first"),
        F.max(end).alias("_last"),
        F.max("_opens").alias("_last_open"),
        F.min("_closes").alias("_first_close"),
    )
    ahead = _key_window(keys).orderBy(SEGMENT)
    back = _key_window(keys).orderBy(F.desc(SEGMENT))
    linked_before = F.col("_first") - F.lag("_last").over(ahead) <= max_gap
    linked_after = F.lag("_first").over(back) - F.col("_last") <= max_gap
    one = one.withColumn("_linked_before", F.coalesce(linked_before, F.lit(False))).withColumn(
        "_linked_after", F.coalesce(linked_after, F.lit(False))
    )
    opened = F.coalesce("_last_open", F.when(~F.col("_linked_before"), F.col("_first")))
    closed = F.coalesce("_first_close", F.when(~F.col("_linked_after"), F.col("_last")))
    earlier = (Window.unboundedPreceding, -1)
    one = one.select(
        *keys,
        SEGMENT,
        F.when(
            F.col("_linked_before"), F.last(opened, True).over(ahead.rowsBetween(*earlier))
        ).otherwise(F.col("_first")).alias("_start"),
        F.when(
            F.col("_linked_after"), F.last(closed, True).over(back.rowsBetween(*earlier))
        ).otherwise(F.col("_last")).alias("_end"),
    )
    return (
        join_on(local, one, [*keys, SEGMENT])
        .withColumn("island_start", F.coalesce(opened_here, F.col("_start")))
        .withColumn("island_end", F.coalesce(closed_here, F.col("_end")))
        .drop("_opens", "_closes", "_start", "_end", SEGMENT)
    )
