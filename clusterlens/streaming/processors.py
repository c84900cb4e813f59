"""Stateful streaming operators: period keep-alive, gap-aware windows, application flush.

All three wait for the event-time watermark, so results do not depend on arrival order or batch cuts, and
they equal those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clusterlens.functions.ids import tag_key, tags_of_key
from clusterlens.operators.extract import INSTANT
from clusterlens.operators.windows import WindowSpec

# A container's periods are spread over this many state keys; its finish marker goes to all of them.
SLOTS = 16
ROWS_PER_FRAME = 5000

PERIOD_INPUT = (
    "us BIGINT, seq BIGINT, rule_id INT, group_id INT, kind STRING, "
    "name STRING, type STRING, app_id STRING, tag_key STRING, value DOUBLE"
)
PERIOD_OUTPUT = (
    "container_id STRING, app_id STRING, us BIGINT, type STRING, name STRING, "
    "tag_key STRING, value DOUBLE"
)
_ORDER = ["us", "seq", "rule_id", "group_id"]
_COLUMNS = [c.split()[0] for c in PERIOD_INPUT.split(", ")]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Output rows; plain objects, so that Arrow builds each column from the declared type."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


class PeriodProcessor(StatefulProcessor):
    """Emits one row per grid tick of every open period of a (container, slot).

    Facts wait until the watermark has passed them and are then applied in order. They lie in the store by grid step, one
    entry each, so that a timer reads the steps that are due, one after another, and leaves the others alone. An open
    period is written once: up to which tick all of them have been emitted is one value. Rows leave in frames of bounded size
    as they are made, so neither many open periods nor a long leap of the watermark is ever held in memory.
    """

    def __init__(self, tick_ms: int):
        self.tick = tick_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step BIGINT", "facts INT")
        self.facts = handle.getMapState("facts", "step BIGINT, number INT", PERIOD_INPUT)
        self.open = handle.getMapState(
            "open", "name STRING, tag_key STRING", "app_id STRING, type STRING, value DOUBLE, first_tick BIGINT"
        )
        self.clock = handle.getValueState("clock", "tick BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        earliest = None
        for part in rows:
            by_step: dict[int, list[tuple]] = {}
            for r in part[_COLUMNS].itertuples(index=False, name=None):
                record = _clean(r)
                by_step.setdefault(record[0] // self.tick, []).append(record)
            for step, records in by_step.items():
                held = self.steps.getValue((step,))[0] if self.steps.containsKey((step,)) else 0
                for number, record in enumerate(records, held):
                    self.facts.updateValue((step, number), record)
                self.steps.updateValue((step,), (held + len(records),))
                first = min(r[0] for r in records)
                earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            self.handle.registerTimer(max(earliest // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        now = watermark_ms * 1000
        last = self.clock.get()[0] if self.clock.exists() else None
        held = {k[0]: v[0] for k, v in self.steps.iterator()}
        due = sorted(s for s in held if s * self.tick <= now)
        if due or last is None or last < now // self.tick:
            yield from self._in_frames(self._advance(key[0], held, due, last, now))
        else:
            self.waiting = False  # another timer of this batch has done all and set the next one
        if self.waiting:
            self.handle.registerTimer(watermark_ms + 1)
        yield pd.DataFrame()

    def _in_frames(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PERIOD_OUTPUT.split(", ")]
        while out := list(islice(rows, ROWS_PER_FRAME)):
            yield _frame(out, names)

    def _advance(self, container: str, held: dict[int, int], due: list[int], last: int | None, now: int) -> Iterator[tuple]:
        later = len(held) > len(due)
        for step in due:
            records = [tuple(self.facts.getValue((step, n))) for n in range(held[step])]
            early = sorted((r for r in records if r[0] <= now), key=lambda r: r[:4])
            rest = [r for r in records if r[0] > now]
            for row in early:
                yield from self._apply(container, row, last)
            for number in range(len(rest), len(records)):
                self.facts.removeKey((step, number))
            for number, row in enumerate(rest):
                self.facts.updateValue((step, number), row)
            if rest:
                self.steps.updateValue((step,), (len(rest),))
                later = True
            else:
                self.steps.removeKey((step,))
        still_open = False
        until = now // self.tick
        for (name, tags), (app, type_, value, first) in self.open.iterator():
            still_open = True
            for t in range(first if last is None else max(first, last + 1), until + 1):
                yield (container, app, t * self.tick, type_, name, tags, value)
        self.clock.update((until,))
        self.waiting = still_open or later

    def _apply(self, container: str, row: tuple, last: int | None) -> Iterator[tuple]:
        us, _, _, _, kind, name, type_, app, tags, value = row
        if kind == "start":
            if not self.open.containsKey((name, tags)):
                self.open.updateValue((name, tags), (app, type_, value, -(-us // self.tick)))
        elif kind == "finish":
            if self.open.containsKey((name, tags)):
                period = self.open.getValue((name, tags))
                self.open.removeKey((name, tags))
                yield from self._closed(container, name, tags, period, us, last, at_least_once=True)
        else:
            for (name, tags), period in self.open.iterator():
                yield from self._closed(container, name, tags, period, us, last, at_least_once=False)
            self.open.clear()

    def _closed(self, container, name, tags, period, us: int, last: int | None, at_least_once: bool) -> Iterator[tuple]:
        app, type_, value, first = period
        end = -(-us // self.tick) - 1
        if at_least_once and (last is None or first > last):
            end = max(end, first)
        for t in range(first if last is None else max(first, last + 1), end + 1):
            yield (container, app, t * self.tick, type_, name, tags, value)

    def close(self) -> None:
        pass


def _clean(record: tuple) -> tuple:
    us, seq, rule_id, group_id, *rest = record
    texts = [None if pd.isna(x) else x for x in rest]
    if texts[-1] is not None:
        texts[-1] = float(texts[-1])
    return (int(us), int(seq), int(rule_id), int(group_id), *texts)


def period_input(messages: DataFrame, container_finish: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Facts and finish markers in the form `PeriodProcessor` takes; the marker goes to every slot.

    `slots` spreads a container over that many state keys. It is part of the state of a query: a restarted one must keep it.
    """
    facts = messages.where(F.col("type") != INSTANT).select(
        "container_id",
        F.pmod(F.xxhash64("name", tag_key(F.col("tags"))), F.lit(slots)).alias("slot"),
        "ts",
        F.unix_micros("ts").alias("us"),
        "seq",
        "rule_id",
        "group_id",
        F.when(F.col("is_finish"), "finish").otherwise("start").alias("kind"),
        "name",
        "type",
        "app_id",
        tag_key(F.col("tags")).alias("tag_key"),
        "value",
    )
    markers = container_finish.select(
        "container_id",
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")).alias("slot"),
        "ts",
        F.unix_micros("ts").alias("us"),
        "seq",
        F.lit(-1).alias("rule_id"),
        F.lit(-1).alias("group_id"),
        F.lit("container").alias("kind"),
    )
    return facts.unionByName(markers, allowMissingColumns=True)


def expand_periods(rows: DataFrame, tick_ms: int, lateness: str = "1 second") -> DataFrame:
    """Streaming twin of `periods.pair` + `periods.expand` over `period_input` rows."""
    ticks = (
        rows.withWatermark("ts", lateness)
        .groupBy("container_id", "slot")
        .transformWithStateInPandas(
            statefulProcessor=PeriodProcessor(tick_ms),
            outputStructType=PERIOD_OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return ticks.select(
        "container_id",
        "app_id",
        F.timestamp_micros("us").alias("ts"),
        "type",
        "name",
        tags_of_key(F.col("tag_key")).alias("tags"),
        "value",
    )


class WindowProcessor(StatefulProcessor):
    """Emits gap-aware windows of one scope from its distinct ticks.

    State is the current run (first tick, last tick, next window number) and the ticks the watermark has
    not passed; ticks whose windows are out leave at once.
    """

    def __init__(self, spec: WindowSpec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first BIGINT, last BIGINT, next_window BIGINT")
        self.pending = handle.getMapState("pending", "tick BIGINT", "seen BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        earliest = None
        for part in rows:
            for tick in part["tick"].tolist():
                self.pending.updateValue((int(tick),), (True,))
                earliest = tick if earliest is None else min(tick, earliest)
        if earliest is not None:
            due = int(earliest) + self.spec.tick
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, step = timerValues.getCurrentWatermarkInMs(), self.spec.tick
        ticks = sorted(k[0] for k in self.pending.keys())
        ready = [t for t in ticks if t + step <= now]
        run = list(self.run.get()) if self.run.exists() else None
        out: list[tuple] = []
        for tick in ready:
            self.pending.removeKey((tick,))
            if run is not None and tick - run[1] > step:
                self._emit(run, out, ended=True)
                run = None
            run = [tick, tick, 0] if run is None else [run[0], tick, run[2]]
            self._emit(run, out, ended=False)
        if run is not None and run[1] + 2 * step <= now:
            self._emit(run, out, ended=True)
            run = None
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(run))
        if run is not None or len(ready) < len(ticks):
            self.handle.registerTimer(now + 1)
        names = [f"scope_{i}" for i in range(len(key))]
        yield _frame([(*key, *o) for o in out], [*names, "window_start", "n_ticks"])

    def _emit(self, run: list[int], out: list[tuple], ended: bool) -> None:
        size, stride, step = self.spec.size, self.spec.stride, self.spec.tick
        length = (run[1] - run[0]) // step + 1
        while run[2] * stride + (1 if ended else size) <= length:
            start = run[2] * stride
            out.append((run[0] + start * step, min(size, length - start)))
            run[2] += 1

    def close(self) -> None:
        pass


def gap_aware_stream(
    cells: DataFrame, spec: WindowSpec, scope: Sequence[str] = (), lateness: str = "1 second"
) -> DataFrame:
    """Streaming twin of `windows.gap_aware`: finished windows (scope, window_start, n_ticks).

    Only distinct ticks reach the stateful operator, however many cells there are. Join the result with
    the stored cells to act on a window's content.
    """
    names = list(scope) or ["scope"]
    ticks = cells if scope else cells.withColumn("scope", F.lit("all"))
    distinct = (
        ticks.withColumn("tick_ts", F.timestamp_millis("tick"))
        .select(*names, "tick", "tick_ts")
        .withWatermark("tick_ts", lateness)
        .dropDuplicates([*names, "tick", "tick_ts"])
    )
    fields = ", ".join(f"scope_{i} STRING" for i in range(len(names)))
    out = distinct.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=WindowProcessor(spec),
        outputStructType=f"{fields}, window_start BIGINT, n_ticks BIGINT",
        outputMode="Append",
        timeMode="EventTime",
    )
    kept = [F.col(f"scope_{i}").alias(n) for i, n in enumerate(names)] if scope else []
    return out.select(*kept, "window_start", "n_ticks")


class AppFlushProcessor(StatefulProcessor):
    """Emits an application once it is finished and has been quiet for a while."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.app = handle.getValueState("app", "last BIGINT, finished BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        last, finished = self.app.get() if self.app.exists() else (None, False)
        for part in rows:
            latest = int(part["ms"].max())
            last = latest if last is None else max(last, latest)
            finished = finished or bool(part["finished"].any())
        self.app.update((last, finished))
        if finished:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(
                max(last + self.quiet, timerValues.getCurrentWatermarkInMs() + 1)
            )
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, finished = self.app.get() if self.app.exists() else (None, False)
        if finished and last + self.quiet <= timerValues.getCurrentWatermarkInMs():
            self.app.clear()
            yield _frame([(key[0], last)], ["app_id", "last_ms"])
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def app_flush_stream(
    cells: DataFrame, finished: DataFrame, quiet_ms: int = 2000, lateness: str = "1 second"
) -> DataFrame:
    """Streaming twin of `plans.flows.flushable_apps`: (app_id, last_ms) when an app may be stored."""
    seen = cells.select("app_id", F.timestamp_millis("tick").alias("ts"), F.lit(False).alias("finished"))
    over = finished.select("app_id", F.col("finished_at").alias("ts"), F.lit(True).alias("finished"))
    rows = (
        seen.unionByName(over)
        .withWatermark("ts", lateness)
        .dropDuplicates(["app_id", "ts", "finished"])
        .withColumn("ms", F.unix_millis("ts"))
    )
    return rows.groupBy("app_id").transformWithStateInPandas(
        statefulProcessor=AppFlushProcessor(quiet_ms),
        outputStructType="app_id STRING, last_ms BIGINT",
        outputMode="Append",
        timeMode="EventTime",
    )
