"""Window statistics of containers and aligned (x, y) series for model fitting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.functions import ids, scalars
from clusterlens.operators import segments, windows
from clusterlens.operators.cells import CELL
from clusterlens.operators.extract import PERIOD
from clusterlens.session import stage

# Reducers of one cell's messages of one key; an absent key counts as 0.
MESSAGE_REDUCERS = {
    "sum": lambda: F.sum("value"),
    "count": lambda: F.count(F.lit(1)).cast("double"),
    "avg": lambda: F.avg("value"),
}
_extractors: dict[str, Extractor | Callable[[DataFrame], DataFrame]] = {}


def worker_containers(df: DataFrame) -> DataFrame:
    """Leave out application masters and unnamed containers."""
    c = F.col("container_id")
    return df.where((c != "null") & ~ids.is_app_master(c))


def window_mean(windowed: DataFrame, column: str, scope: Sequence[str] = ()) -> DataFrame:
    """Mean per (window, container) over the window's ticks, also those without the container."""
    return windowed.groupBy(*scope, "window_start", "container_id").agg(
        (F.sum(column) / F.max("n_ticks")).alias("mean")
    )


def window_key_counts(
    windowed: DataFrame, counts: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Period messages per (window, container, key) at the container's last tick in the window.

    `counts` is `cells.message_counts`; containers whose last tick has no period message give no row.
    """
    last = windowed.groupBy(*scope, "window_start", "container_id").agg(F.max("tick").alias("tick"))
    return _counts_at(last, counts, scope)


def _counts_at(last: DataFrame, counts: DataFrame, scope: Sequence[str]) -> DataFrame:
    wanted = counts.where(F.col("kind") == PERIOD).select(*CELL, "key", "n")
    return segments.join_on(last, wanted, list(CELL)).select(
        *scope, "window_start", "container_id", "tick", "key", "n"
    )


def pane_mean(
    cells: DataFrame, spec: windows.WindowSpec, column: str, scope: Sequence[str] = ()
) -> DataFrame:
    """`window_mean` of all windows of stored cells, by panes: no cell is copied to its windows."""
    return windows.reduce_by_panes(
        cells,
        spec,
        ["container_id"],
        [F.sum(column).alias("_sum")],
        [(F.sum("_sum") / F.max("n_ticks")).alias("mean")],
        scope,
    )


def pane_key_counts(
    cells: DataFrame, counts: DataFrame, spec: windows.WindowSpec, scope: Sequence[str] = ()
) -> DataFrame:
    """`window_key_counts` of all windows of stored cells, by panes."""
    latest = [F.max("tick").alias("tick")]
    last = windows.reduce_by_panes(cells, spec, ["container_id"], latest, latest, scope)
    return _counts_at(last, counts, scope)


def period_keys(long: DataFrame) -> DataFrame:
    return long.where(F.col("kind") == PERIOD).select("key").distinct()


def reduce_messages(long: DataFrame, how: str | Sequence[str]) -> DataFrame:
    """Value of a key in a cell: sum, count or avg of its messages, as `x`.

    Several reducers come from one aggregate, each as `x_` and its name.
    """
    names = {how: "x"} if isinstance(how, str) else {h: f"x_{h}" for h in how}
    for h in names:
        if h not in MESSAGE_REDUCERS:
            raise ValueError(f"unknown message reducer: {h}")
    return long.groupBy(*CELL, "kind", "key").agg(*[MESSAGE_REDUCERS[h]().alias(x) for h, x in names.items()])


def key_range(long: DataFrame, key: str, kind: str = PERIOD) -> DataFrame:
    """First and last tick of a key per container; a key in one tick only has no range."""
    return (
        long.where((F.col("kind") == kind) & (F.col("key") == key))
        .groupBy("container_id")
        .agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))
        .where(F.col("last_tick") > F.col("first_tick"))
    )


def metric_delta(
    cells: DataFrame, metric: str, keys: Sequence[str] = ("container_id",), **cut
) -> DataFrame:
    """Add `delta`: change of a metric from the container's previous row, the first against 0."""
    rows = segments.lag(
        cells, list(keys), F.col("tick"), ["tick"], {"_before": metric}, **cut
    )
    return rows.withColumn("delta", F.col(metric) - F.coalesce("_before", F.lit(0.0))).drop("_before")


def aligned_series(
    cells: DataFrame,
    long: DataFrame,
    metric: str,
    key: str,
    how: str = "count",
    kind: str = PERIOD,
    use_rate: bool = False,
    **cut,
) -> DataFrame:
    """Series (tick, container_id, x, y) of worker containers inside the key's presence range.

    x is the reduced value of the key's messages in the cell (0 when absent), y the metric or its change.
    The reduced side is an aggregate; the joins are on the container (with AQE splitting a hot one) and
    on the unique cell.
    """
    wanted = long.where((F.col("kind") == kind) & (F.col("key") == key))
    x = reduce_messages(wanted, how).select(*CELL, "x")
    rows = (
        worker_containers(cells)
        .select(*CELL, F.col(metric).alias("y"))
        .join(key_range(wanted, key, kind), "container_id")
        .where(F.col("tick").between(F.col("first_tick"), F.col("last_tick")))
        .select(*CELL, "y")
        .join(x, CELL, "left")
        .withColumn("x", F.coalesce("x", F.lit(0.0)))
    )
    if use_rate:
        rows = metric_delta(stage(rows), "y", **cut).withColumn("y", F.col("delta"))
    return rows.select(*CELL, "x", "y")


def union_sources(series: dict[str, DataFrame]) -> DataFrame:
    """Series of several snapshots in one table, told apart by `source`."""
    out = None
    for name, df in series.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def training_set(series: DataFrame, size: int, stride: int, **cut) -> DataFrame:
    """Windowed (x, y) per source: x summed, y the maximum in MB, in (tick, container) order.

    A tick of so many containers that it is crowded is cut by container, so no task gets a whole tick.
    """
    out = windows.positional_reduce(
        stage(series),
        F.col("tick"),
        ["tick", "container_id"],
        size,
        stride,
        ["source"],
        {"x": ("sum", "x"), "y": ("max", "y")},
        minor="container_id",
        **cut,
    )
    return out.withColumn("y", scalars.to_megabytes(F.col("y")))


@dataclass(frozen=True)
class Extractor:
    """A value per window and container: `partial` aggregates over the cells of a pane, `final` over the panes of a window.

    Both are asked for when the extractor runs. `final` sees the columns of `partial` and the window's `n_ticks`, and names
    its result `value`.
    """

    partial: Callable[[], Sequence[Column]]
    final: Callable[[], Column]


def register_extractor(name: str, extractor: Extractor | Callable[[DataFrame], DataFrame]) -> None:
    """A named extractor; a function from windowed cells to (window_start, container_id, value) is the form for what does
    not come from parts."""
    _extractors[name] = extractor


def run_extractor(name: str, cells: DataFrame, spec: windows.WindowSpec | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Values of an extractor over stored cells. One of parts runs by panes, so no cell is copied to its windows; a function
    gets the windowed cells. Without `spec` the cells are windowed already."""
    extractor = _extractors[name]
    if isinstance(extractor, Extractor):
        if spec is None:
            grouped = cells.groupBy(*scope, "window_start", "container_id", "n_ticks").agg(*extractor.partial())
            return grouped.groupBy(*scope, "window_start", "container_id").agg(extractor.final())
        return windows.reduce_by_panes(cells, spec, ["container_id"], extractor.partial(), [extractor.final()], scope)
    return extractor(cells if spec is None else windows.windowed(cells, spec, scope))


register_extractor(
    "memory",
    Extractor(
        lambda: [F.sum("memory").alias("_sum")], lambda: (F.sum("_sum") / F.max("n_ticks")).alias("value")
    ),
)
