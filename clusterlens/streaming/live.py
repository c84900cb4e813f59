"""The live path: cells while records are consumed, windows with their cells, and the detection run.

Cells need no operator of their own: they are one event-time aggregate, kept in the state store per (tick, container) and
closed by the watermark. Windows with content do: gap-aware windows depend on the ticks of the whole scope, their content on
the container. So every distinct tick goes to all slots of its scope, a cell only to the slot of its container, and each slot
cuts the same windows and fills them with its own cells. No state key ever holds all cells of a scope.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from clusterlens.operators import cells as batch_cells
from clusterlens.operators import extract
from clusterlens.operators.cells import CELL
from clusterlens.operators.metrics import METRIC_COLUMNS
from clusterlens.operators.windows import WindowSpec, tick
from clusterlens.streaming import actions, queries
from clusterlens.streaming.processors import _frame

SLOTS = 16
ROWS_PER_FRAME = 5000
KINDS = ("period", "instant")


# ---- cells


def _message_map(kind: str) -> Column:
    """key -> messages of one kind in order of arrival, from the sorted list of a cell's messages; null for a cell without any."""
    of_kind = F.filter("_messages", lambda m: m["kind"] == kind)
    keys = F.array_distinct(F.transform(of_kind, lambda m: m["key"]))

    def of_key(key: Column) -> Column:
        mine = F.filter(of_kind, lambda m: m["key"] == key)
        return F.transform(mine, lambda m: F.struct(m["key"].alias("key"), m["identifiers"].alias("identifiers"), m["value"].alias("value")))

    has_any = F.exists("_messages", lambda m: m["kind"].isNotNull())
    return F.when(has_any, F.map_from_arrays(keys, F.transform(keys, of_key)))


def cells(samples: DataFrame, messages: DataFrame, tick_ms: int, lateness: str = "1 second") -> DataFrame:
    """Streaming twin of `cells.build` with `cells.message_maps`: one row per cell once the watermark has passed its tick.

    Columns are those of both, and `closed_at`, the end of the tick as event time for operators behind. The last write of a
    metric wins by `seq`, messages are listed by `seq`. State is one group per open (tick, container); the list of a cell is
    the only part that grows, with the messages of one tick. A sample or fact older than the watermark is dropped, see
    `queries.split_late` for an output of such rows. A cell of a container without messages has null maps.
    """
    columns = list(METRIC_COLUMNS.values())
    left = batch_cells.valid_container(samples).select(
        "ts", "container_id", "app_id", "seq", F.struct(*columns).alias("_m")
    )
    right = batch_cells.container_or_app(messages)
    kind = F.when(F.col("type") == extract.PERIOD, extract.PERIOD).when(F.col("type").isNotNull(), extract.INSTANT)
    names = batch_cells.identifiers(F.col("tags"))
    message = F.struct(
        "seq",
        F.to_json(F.map_entries(names)).alias("ident"),
        kind.alias("kind"),
        F.col("name").alias("key"),
        names.alias("identifiers"),
        "value",
    )
    right = right.select("ts", "container_id", "app_id", "seq", message.alias("_message"))
    sides = left.unionByName(right, allowMissingColumns=True).withWatermark("ts", lateness)
    is_sample = F.col("_m").isNotNull()
    length = F.window("ts", f"{tick_ms} milliseconds").alias("_tick")
    # a stamp of at most ten digits is its own tick
    grouped = sides.groupBy(length, tick(F.unix_millis("ts"), tick_ms).alias("tick"), "container_id").agg(
        F.max_by("_m", F.when(is_sample, F.col("seq"))).alias("_m"),
        F.max_by("app_id", F.when(F.col("app_id").isNotNull(), F.col("seq"))).alias("app_id"),
        F.collect_list("_message").alias("_messages"),
    )

    def by_arrival(a: Column, b: Column) -> Column:
        order = F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1)
        return order.when(a["ident"] < b["ident"], -1).when(a["ident"] > b["ident"], 1).otherwise(0)

    grouped = grouped.withColumn("_messages", F.array_sort("_messages", by_arrival))
    return grouped.select(
        *CELL,
        "app_id",
        *[F.coalesce(F.col("_m")[c], F.lit(0.0)).alias(c) for c in columns],
        F.col("_m").isNotNull().alias("has_metrics"),
        F.size(F.filter("_messages", lambda m: m["kind"].isNotNull())).cast("bigint").alias("n_messages"),
        *[_message_map(kind).alias(f"{kind}_messages") for kind in KINDS],
        F.window_time("_tick").alias("closed_at"),
    )


# ---- windows with content


class ContentProcessor(StatefulProcessor):
    """Gap-aware windows of one (scope, slot) with the cells of that slot.

    State: the current run (first tick, last tick, next window), how many cells each tick has, and the cells one by one under
    (tick, number), so that a window reads its ticks and nothing else. Ticks no window will hold any more leave at once.
    """

    def __init__(self, spec: WindowSpec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first BIGINT, last BIGINT, next_window BIGINT")
        self.ticks = handle.getMapState("ticks", "tick BIGINT", "cells INT, taken BOOLEAN")
        self.cells = handle.getMapState("cells", "tick BIGINT, number INT", "cell STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        found: dict[int, list[str]] = {}
        for part in rows:
            for at, cell in zip(part["tick"].tolist(), part["cell"].tolist(), strict=True):
                mine = found.setdefault(int(at), [])
                if cell is not None:
                    mine.append(cell)
        for at, some in found.items():
            held, taken = self.ticks.getValue((at,)) if self.ticks.containsKey((at,)) else (0, False)
            for number, cell in enumerate(some, held):
                self.cells.updateValue((at, number), (cell,))
            self.ticks.updateValue((at,), (held + len(some), taken))
        if found:
            due = min(found) + self.spec.tick
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, step = timerValues.getCurrentWatermarkInMs(), self.spec.tick
        held = {k[0]: tuple(v) for k, v in self.ticks.iterator()}
        waiting = sorted(t for t, (_, taken) in held.items() if not taken)
        ready = [t for t in waiting if t + step <= now]
        run = list(self.run.get()) if self.run.exists() else None
        self.held, self.key = held, key
        for at in ready:
            if run is not None and at - run[1] > step:
                yield from self._emit(run, ended=True)
                run = None
            run = [at, at, 0] if run is None else [run[0], at, run[2]]
            self.held[at] = (self.held[at][0], True)
            self.ticks.updateValue((at,), self.held[at])
            yield from self._emit(run, ended=False)
        if run is not None and run[1] + 2 * step <= now:
            yield from self._emit(run, ended=True)
            run = None
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(run))
        if run is not None or len(ready) < len(waiting):
            self.handle.registerTimer(now + 1)
        yield pd.DataFrame()

    def _emit(self, run: list[int], ended: bool) -> Iterator[pd.DataFrame]:
        size, stride, step = self.spec.size, self.spec.stride, self.spec.tick
        length = (run[1] - run[0]) // step + 1
        names = [*(f"scope_{i}" for i in range(len(self.key) - 1)), "window_start", "n_ticks", "cell"]
        while run[2] * stride + (1 if ended else size) <= length:
            start = run[2] * stride
            ticks = [run[0] + k * step for k in range(start, min(start + size, length))]
            scope, out = self.key[:-1], []
            for at in ticks:
                for number in range(self.held[at][0]):
                    out.append((*scope, ticks[0], len(ticks), self.cells.getValue((at, number))[0]))
                    if len(out) >= ROWS_PER_FRAME:
                        yield _frame(out, names)
                        out = []
            if out:
                yield _frame(out, names)
            run[2] += 1
        keep_from = run[0] + run[2] * stride * step if not ended else run[1] + step
        for at in [t for t in self.held if run[0] <= t < min(keep_from, run[1] + step)]:
            for number in range(self.held[at][0]):
                self.cells.removeKey((at, number))
            self.ticks.removeKey((at,))
            del self.held[at]

    def close(self) -> None:
        pass


def windowed(
    cell_stream: DataFrame, spec: WindowSpec, scope: Sequence[str] = (), lateness: str = "1 second", slots: int = SLOTS
) -> DataFrame:
    """Streaming twin of `windows.windowed`: every cell once per finished window it is in, with `window_start`, `n_ticks`.

    `cell_stream` has `tick` and `container_id`, and `closed_at` as watermarked event time where it comes from `cells`.
    `slots` spreads a scope over that many state keys; it is part of the query's state, so a restarted query must keep it.
    """
    names = list(scope) or ["scope"]
    rows = cell_stream if scope else cell_stream.withColumn("scope", F.lit("all"))
    if "closed_at" not in rows.columns:
        rows = rows.withColumn("closed_at", F.timestamp_millis("tick")).withWatermark("closed_at", lateness)
    content = [c for c in cell_stream.columns if c != "closed_at"]
    packed = rows.select(*names, "tick", "closed_at", "container_id", F.to_json(F.struct(*content), {"ignoreNullFields": "false"}).alias("cell"))
    own = F.pmod(F.xxhash64("container_id"), F.lit(slots)).cast("int")
    filled = packed.select(*names, own.alias("slot"), "tick", "closed_at", "cell")
    # a tick reaches all slots, once or a few times; what it says does not change
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    known = packed.select(*names, "tick", "closed_at").dropDuplicates([*names, "tick", "closed_at"])
    marks = known.select(*names, every.alias("slot"), "tick", "closed_at", F.lit(None).cast("string").alias("cell"))
    fields = ", ".join(f"scope_{i} STRING" for i in range(len(names)))
    out = (
        filled.unionByName(marks)
        .groupBy(*names, "slot")
        .transformWithStateInPandas(
            statefulProcessor=ContentProcessor(spec),
            outputStructType=f"{fields}, window_start BIGINT, n_ticks BIGINT, cell STRING",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    cell_type = StructType([cell_stream.schema[c] for c in content])
    return out.select(F.from_json("cell", cell_type).alias("_cell"), "window_start", "n_ticks").select(
        "_cell.*", "window_start", "n_ticks"
    )


# ---- the detection run


@dataclass
class Detection:
    """A running detection: one query fills the table of windows, each action follows that table at its own pace."""

    windows: StreamingQuery
    actions: actions.Registry
    path: str

    def drain(self, seconds: int = 600) -> None:
        """Wait for the windows of all there is, then let every action see them and stop."""
        if not self.windows.awaitTermination(seconds):
            raise TimeoutError("the stream of windows did not end")
        self.actions.drain(seconds)

    def stop(self) -> None:
        self.windows.stop()
        for name in list(self.actions.running):
            self.actions.unregister(name)


def detect(
    spark: SparkSession,
    cell_stream: DataFrame,
    path: str,
    spec: WindowSpec,
    checkpoints: str,
    scope: Sequence[str] = (),
    lateness: str = "1 second",
    trigger: str | None = "1 second",
) -> Detection:
    """Drain windows live: records are parsed once, by the query that writes finished windows with their cells to `path`.

    Actions registered on the result read that table as a stream, so each sees all windows however many there are, has its own
    progress, and a slow one holds up no other. `trigger=None` takes what is there and stops.
    """
    live = windowed(cell_stream, spec, scope, lateness)
    table = f"{path}/windows"
    spark.createDataFrame([], live.schema).write.mode("append").parquet(f"{table}/batch_id=-1")
    query = queries.start(live, queries.append_table(table), "windows", checkpoints, trigger)
    follow = spark.readStream.schema(live.schema).parquet(f"{table}/batch_id=*")
    return Detection(query, actions.Registry(follow, checkpoints, trigger is None), path)

