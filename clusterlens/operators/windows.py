"""Ticks, gap-aware sliding windows, positional hopping windows and idle sessions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.operators import segments
from clusterlens.session import stage

DEFAULT_SIZE = 1000
# A chunk of windows in lengths of a window, and copies of panes to windows that one task makes.
CHUNK = 8
COPIES = 500_000


def tick(epoch_ms: Column, size_ms: int) -> Column:
    """Start of the tick; stamps of at most ten digits (seconds) stay as they are."""
    long_stamp = F.length(epoch_ms.cast("string")) > 10
    return F.when(long_stamp, epoch_ms - F.pmod(epoch_ms, F.lit(size_ms))).otherwise(epoch_ms)


@dataclass(frozen=True)
class WindowSpec:
    """Window length and stride in ticks, and the tick length."""

    size: int
    stride: int
    tick: int = 1

    @classmethod
    def from_options(
        cls,
        size: int = DEFAULT_SIZE,
        stride: int | None = None,
        tick: int = 1,
        ms_resolution: bool = False,
    ) -> WindowSpec:
        """Options as given: below 1000 without ms resolution means 1000/1000; a stride above the
        length is cut to it."""
        stride = size if stride is None else stride
        if not ms_resolution and size < DEFAULT_SIZE:
            size = stride = DEFAULT_SIZE
        return cls(size, min(stride, size), tick)

    def __post_init__(self):
        if min(self.size, self.stride, self.tick) < 1 or self.stride > self.size:
            raise ValueError(f"bad window: {self}")


def _div(a: Column, b: int) -> Column:
    """Integer quotient of non-negative numbers."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def gap_aware(
    cells: DataFrame, spec: WindowSpec, scope: Sequence[str] = (), upper: Column | None = None
) -> DataFrame:
    """Window membership of ticks: (scope, tick, window_start, n_ticks).

    Windows start every `stride` ticks inside a run of consecutive ticks, hold up to `size` ticks and
    never cross a gap. Only distinct ticks are numbered, one row however many containers reported.
    `upper` (epoch ms) leaves out ticks that may still be filling.
    """
    pos = _div(F.col("tick") - F.col("island_start"), spec.tick)
    return _spread(_runs(cells, spec, scope, upper), spec, *_holding(spec, pos)).select(*scope, "tick", "window_start", "n_ticks")


def _runs(cells: DataFrame, spec: WindowSpec, scope: Sequence[str], upper: Column | None) -> DataFrame:
    """Distinct ticks with the ends of their runs."""
    ticks = cells.select(*scope, "tick").distinct()
    if upper is not None:
        ticks = ticks.where(F.col("tick") <= tick(upper, spec.tick))
    return segments.islands(stage(ticks), list(scope), "tick", spec.tick)


def _holding(spec: WindowSpec, pos: Column) -> tuple[Column, Column]:
    """Numbers of the first and the last window that hold place `pos` of their run."""
    first = F.when(pos < spec.size, F.lit(0)).otherwise(
        _div(pos - spec.size + spec.stride, spec.stride)
    )
    return first.cast("bigint"), _div(pos, spec.stride)


def _spread(rows: DataFrame, spec: WindowSpec, first: Column, last: Column) -> DataFrame:
    """Rows of runs once per window from number `first` to `last`."""
    length = _div(F.col("island_end") - F.col("island_start"), spec.tick) + 1
    return (
        rows.withColumn("_k", F.explode(F.sequence(first, last)))
        .withColumn(
            "n_ticks", F.least(F.lit(spec.size), length - F.col("_k") * spec.stride).cast("bigint")
        )
        .withColumn("window_start", F.col("island_start") + F.col("_k") * spec.stride * spec.tick)
        .drop("_k")
    )


def reduce_by_panes(
    cells: DataFrame,
    spec: WindowSpec,
    keys: Sequence[str],
    partial: Sequence[Column],
    final: Sequence[Column],
    scope: Sequence[str] = (),
    upper: Column | None = None,
) -> DataFrame:
    """One row per (window, keys): `partial` over each pane, then `final` over the panes of each window.

    A pane is the greatest common divisor of length and stride, in ticks of a run, so windows hold whole
    panes. Cells are reduced to panes before any row is copied to the windows it is in. `final` sees the
    columns of `partial`, and `n_ticks` of the window. Give stored cells: they are counted and their ticks read first.

    Windows go in chunks of their run, so long that a pane is in two at most. All of a key and chunk is in one task, so only cells
    are shuffled, never their copies, and a task makes about `COPIES` of them however many there are in all.
    """
    pane = math.gcd(spec.size, spec.stride)
    runs = _runs(cells, spec, scope, upper)
    rows = segments.join_on(cells, runs, [*scope, "tick"])
    fan = math.ceil(spec.size / spec.stride)
    length = CHUNK * fan
    place = _div(F.col("tick") - F.col("island_start"), spec.tick * pane)
    first, last = _holding(spec, F.col("_pane") * pane)
    rows = rows.withColumn("_pane", place).withColumn("_chunk", F.explode(F.sequence(_div(first, length), _div(last, length))))
    group = [*scope, *keys, "island_start", "_chunk"]
    rows = segments.deal(rows, group, fan * cells.count(), COPIES)
    panes = rows.groupBy(*group, "island_end", "_pane").agg(*partial)
    start = F.col("_chunk") * length
    copies = _spread(panes, spec, F.greatest(first, start), F.least(last, start + length - 1))
    out = copies.groupBy(*group, "window_start").agg(*final).drop("island_start", "_chunk")
    head = [*scope, "window_start", *keys]
    return out.select(*head, *[c for c in out.columns if c not in head])


def windowed(
    cells: DataFrame, spec: WindowSpec, scope: Sequence[str] = (), upper: Column | None = None
) -> DataFrame:
    """Every cell once per window it is in. Give stored cells: their ticks are read first."""
    return segments.join_on(cells, gap_aware(cells, spec, scope, upper), [*scope, "tick"])


def flag_late(rows: DataFrame, batch: str, delay_ms: int, ts: str = "ts") -> DataFrame:
    """Batch twin of `queries.split_late`: rows with `is_late`, `batch` being the number of the batch each came in.

    Only one row per batch is ordered. Rows without a time are not late.
    """
    per_batch = rows.groupBy(batch).agg(F.max(F.unix_micros(ts)).alias("_latest"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    limits = per_batch.select(batch, (F.max("_latest").over(before) - delay_ms * 1000).alias("_limit"))
    out = segments.join_on(rows, limits, [batch], "left")
    return out.withColumn("is_late", F.coalesce(F.unix_micros(ts) < F.col("_limit"), F.lit(False))).drop("_limit")


def positional(
    df: DataFrame,
    axis: Column,
    order: Sequence[str],
    size: int,
    stride: int,
    scope: Sequence[str],
    aggs: Sequence[Column],
    **cut,
) -> DataFrame:
    """Hopping windows over row positions: starts at 0, stride, ... up to the first partial window."""
    rows = segments.running_count(
        df, list(scope), axis, list(order), F.lit(True), "_pos", total="_n", **cut
    )
    n, pos = F.col("_n"), F.col("_pos")
    last = F.when(n < size, F.lit(0)).otherwise(_div(n - size, stride) + 1)
    lo = F.when(pos < size, F.lit(0)).otherwise(_div(pos - size + stride, stride)).cast("bigint")
    hi = F.least(last.cast("bigint"), _div(pos, stride))
    return (
        rows.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("window_no", F.explode(F.sequence("_lo", "_hi")))
        .groupBy(*scope, "window_no")
        .agg(*aggs)
    )


# Mergeable parts of the reducers below, each as (aggregate of values, aggregate of parts), and how they make the value.
PARTS = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}
MERGED: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "avg": (("sum", "count"), lambda s, n: s / n),
    "max": (("max",), lambda x: x),
    "min": (("min",), lambda x: x),
    "delta": (("max", "min"), lambda high, low: high - low),
    "sum": (("sum",), lambda x: x),
    "count": (("count",), lambda n: n),
}


def positional_reduce(
    df: DataFrame,
    axis: Column,
    order: Sequence[str],
    size: int,
    stride: int,
    scope: Sequence[str],
    reductions: dict[str, tuple[str, str]],
    **cut,
) -> DataFrame:
    """`positional` for reducers by name, without copying a row: `reductions` maps an output to (reducer, column).

    Positions lie in blocks of `size` rows. Each row gets the parts of its block up to it and from it on. A window is the end of
    the block it starts in and the beginning of the next, so it takes two rows, merged: at most 2 / `stride` of the rows
    go on, whatever `size` is. The rows with their parts are stored, so their order is worked out once for all that is picked from them.
    """
    for how, _ in reductions.values():
        if how not in MERGED:
            raise ValueError(f"unknown window reducer: {how}")
    rows = segments.running_count(df, list(scope), axis, list(order), F.lit(True), "_pos", total="_n", **cut)
    placed = stage(rows.select(*scope, *dict.fromkeys(c for _, c in reductions.values()), "_pos", "_n"))
    n_rows = placed.count()
    parts = list(dict.fromkeys((part, column) for how, column in reductions.values() for part in MERGED[how][0]))
    name = {pair: f"_part{i}" for i, pair in enumerate(parts)}
    n, pos = F.col("_n"), F.col("_pos")
    rows = segments.deal(placed.withColumn("_block", _div(pos, size)), [*scope, "_block"], n_rows)
    block = Window.partitionBy(*scope, "_block")
    frame = (Window.unboundedPreceding, 0)
    ahead, back = block.orderBy("_pos").rowsBetween(*frame), block.orderBy(F.desc("_pos")).rowsBetween(*frame)
    sides = {"_head": ahead, "_tail": back}
    rows = rows.select(
        *scope, "_pos", "_n",
        *[PARTS[p][0](c).over(w).alias(f"{side}{name[p, c]}") for side, w in sides.items() for p, c in parts],
    )
    rows = stage(rows)
    last = F.when(n < size, F.lit(0)).otherwise(_div(n - size, stride) + 1).cast("bigint")

    def halves(which: Column, side: str, window_no: Column) -> DataFrame:
        columns = [F.col(f"{side}{name[x]}").alias(name[x]) for x in parts]
        return rows.where(which).select(*scope, window_no.alias("window_no"), *columns)

    # a window opens with the tail of its first row; the head of its last row joins it where that lies in the next block
    opens = (F.pmod(pos, F.lit(stride)) == 0) & (_div(pos, stride) <= last)
    start = pos - F.lit(size - 1)
    closes = (start >= 0) & (F.pmod(start, F.lit(stride)) == 0) & (F.pmod(start, F.lit(size)) != 0)
    # only the last window can be cut short by the end of the series
    short = last * stride
    cut_off = (pos == n - 1) & (short > n - size) & (short < pos - F.pmod(pos, F.lit(size)))
    tails, heads = halves(opens, "_tail", _div(pos, stride)), halves(closes, "_head", _div(F.greatest(start, F.lit(0)), stride))
    ends = halves(cut_off, "_head", last)
    both = segments.deal(tails.unionByName(heads).unionByName(ends), [*scope, "window_no"], 2 * n_rows // stride)
    merged = both.groupBy(*scope, "window_no").agg(
        *[PARTS[p][1](name[p, c]).alias(name[p, c]) for p, c in parts]
    )
    values = [MERGED[how][1](*[F.col(name[p, c]) for p in MERGED[how][0]]).alias(out) for out, (how, c) in reductions.items()]
    return merged.select(*scope, "window_no", *values)


# Reducers of a window of values, by name.
REDUCERS = {
    "avg": F.avg,
    "max": F.max,
    "min": F.min,
    "delta": lambda c: F.max(c) - F.min(c),
    "sum": F.sum,
    "count": F.count,
}


def reducer(how: str, column: str) -> Column:
    if how not in REDUCERS:
        raise ValueError(f"unknown window reducer: {how}")
    return REDUCERS[how](column)


def idle_sessions(
    df: DataFrame, gap_ms: int, scope: Sequence[str] = (), ts: str = "ts", **cut
) -> DataFrame:
    """Sessions of activity: a pause of at least `gap_ms` ends one.

    Rows closer than the gap are one session anyway, so each stretch of that length shrinks to one row
    with its first and last time before anything is ordered.
    """
    gap = gap_ms * 1000
    us = segments.micros(ts)
    stretches = stage(
        df.groupBy(*scope, (us - F.pmod(us, F.lit(gap))).alias("_stretch")).agg(
            F.min(us).alias("_from"), F.max(us).alias("_to"), F.count(F.lit(1)).alias("_n")
        )
    )
    runs = segments.islands(stretches, list(scope), "_from", gap - 1, until="_to", **cut)
    return (
        runs.groupBy(*scope, "island_start", "island_end")
        .agg(F.sum("_n").alias("n_rows"))
        .select(
            *scope,
            F.timestamp_micros("island_start").alias("session_start"),
            F.timestamp_micros("island_end").alias("session_end"),
            "n_rows",
        )
    )
