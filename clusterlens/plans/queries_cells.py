"""Queries on cells, windows, counters and flushes."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterlens.operators import cells, features, metrics, segments, states, windows
from clusterlens.operators.metrics import METRIC_COLUMNS
from clusterlens.operators.windows import WindowSpec
from clusterlens.plans import demo, flows
from clusterlens.plans.catalog import query
from clusterlens.session import new_folder, stage
from clusterlens.sinks import snapshots
from clusterlens.sources import logs

SPEC = WindowSpec(3, 2, demo.MINUTE)
METRICS = list(METRIC_COLUMNS.values())
_METRIC_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)


def _rounded(columns=METRICS):
    return [F.round(c, 6).alias(c) for c in columns]


def _us(column: str = "ts"):
    return F.unix_micros(column)


@query("win1_ticks", "SELECT event_id, ms - ms % 60000 AS tick, ms // 1000 AS second FROM ev")
def ticks(spark, sf_dir):
    """Millisecond stamps go to their minute, second stamps stay."""
    ms = F.unix_millis("ts")
    second = F.floor(ms / 1000)
    return demo.events(spark, sf_dir).select(
        "event_id",
        windows.tick(ms, demo.MINUTE).alias("tick"),
        windows.tick(second, demo.MINUTE).alias("second"),
    )


@query("agg1_metric_cells", f"SELECT tick, container_id, app_id, {_METRIC_SQL} FROM mcell")
def metric_cells(spark, sf_dir):
    points = metrics.unpivot(demo.samples(spark, sf_dir))
    return cells.metric_cells(points, demo.MINUTE).select("tick", "container_id", "app_id", *_rounded())


@query("agg1_sample_cells", f"SELECT tick, container_id, app_id, {_METRIC_SQL} FROM mcell")
def sample_cells(spark, sf_dir):
    return demo.sample_cells(spark, sf_dir).select("tick", "container_id", "app_id", *_rounded())


@query(
    "jon9_cells",
    """WITH log AS (SELECT (us // 1000) - (us // 1000) % 60000 AS tick, container_id, count(*) AS n
        FROM cf GROUP BY ALL)
    SELECT coalesce(m.tick, l.tick) AS tick, coalesce(m.container_id, l.container_id) AS container_id,
      coalesce(round(m.memory, 6), 0.0) AS memory, coalesce(round(m.net_rate, 6), 0.0) AS net_rate,
      m.tick IS NOT NULL AS has_metrics, coalesce(l.n, 0)::BIGINT AS n_messages
    FROM mcell m FULL JOIN log l ON m.tick = l.tick AND m.container_id = l.container_id""",
)
def all_cells(spark, sf_dir):
    built = cells.build(demo.samples(spark, sf_dir), demo.container_facts(spark, sf_dir), demo.MINUTE)
    return built.select(
        "tick", "container_id", *_rounded(["memory", "net_rate"]), "has_metrics", "n_messages"
    )


@query(
    "agg2_message_counts",
    """SELECT (us // 1000) - (us // 1000) % 3600000 AS tick, container_id, type AS kind, name AS key,
      count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM cf GROUP BY ALL""",
)
def message_counts(spark, sf_dir):
    long = cells.cell_messages(demo.container_facts(spark, sf_dir), demo.HOUR)
    return cells.message_counts(long).withColumn("total", F.round("total", 4))


@query(
    "agg2_message_maps",
    """SELECT (us // 1000) - (us // 1000) % 3600000 AS tick, container_id, type AS kind, name AS key,
      string_agg(coalesce(tag_value, '-'), ',' ORDER BY seq) AS messages FROM cf GROUP BY ALL""",
)
def message_maps(spark, sf_dir):
    """The nested maps of every cell, shown as one text per key."""
    long = cells.cell_messages(demo.stored_facts(spark, sf_dir), demo.HOUR)
    maps = cells.message_maps(long)
    kinds = None
    for kind in ("period", "instant"):
        one = maps.select(
            "tick", "container_id", F.lit(kind).alias("kind"), F.explode(f"{kind}_messages").alias("key", "_list")
        )
        kinds = one if kinds is None else kinds.unionByName(one)
    tag = F.transform(
        "_list",
        lambda m: F.coalesce(m["identifiers"]["stageID"], m["identifiers"]["TID"], F.lit("-")),
    )
    return kinds.select("tick", "container_id", "kind", "key", F.array_join(tag, ",").alias("messages"))


@query(
    "agg6_period_keys",
    "SELECT DISTINCT name AS key FROM cf WHERE type = 'period'",
)
def period_keys(spark, sf_dir):
    return features.period_keys(cells.cell_messages(demo.container_facts(spark, sf_dir), demo.HOUR))


@query(
    "agg7_message_reducers",
    """SELECT (us // 1000) - (us // 1000) % 3600000 AS tick, container_id, type AS kind, name AS key,
      round(sum(value), 4) AS x_sum, count(*)::DOUBLE AS x_count, round(avg(value), 4) AS x_avg
    FROM cf GROUP BY ALL""",
)
def message_reducers(spark, sf_dir):
    long = cells.cell_messages(demo.container_facts(spark, sf_dir), demo.HOUR)
    rows = features.reduce_messages(long, ("sum", "count", "avg"))
    return rows.withColumns({c: F.round(c, 4) for c in ("x_sum", "x_avg")})


@query(
    "agg10_active_containers",
    """WITH n AS (SELECT tick, count(DISTINCT container_id)::BIGINT AS containers FROM mcell GROUP BY tick)
    SELECT tick, containers FROM (SELECT *, lag(containers) OVER (ORDER BY tick) AS b FROM n)
    WHERE containers IS DISTINCT FROM b""",
)
def active_containers(spark, sf_dir):
    return cells.active_containers(demo.sample_cells(spark, sf_dir))


@query("win3_gap_aware", "SELECT tick, window_start, n_ticks::BIGINT AS n_ticks FROM win")
def gap_aware(spark, sf_dir):
    return windows.gap_aware(demo.sample_cells(spark, sf_dir), SPEC)


@query(
    "str6_upper_bound",
    """WITH b AS (SELECT tick, tick // 60000 AS t FROM (SELECT DISTINCT tick FROM mcell
        WHERE tick <= epoch_ms(TIMESTAMP '2024-01-15 12:30:00'))),
    i AS (SELECT tick, t, t - row_number() OVER (ORDER BY t) AS g FROM b),
    q AS (SELECT tick, t, row_number() OVER (PARTITION BY g ORDER BY t) - 1 AS p,
        count(*) OVER (PARTITION BY g) AS n, min(t) OVER (PARTITION BY g) AS t0 FROM i)
    SELECT tick, (t0 + k * 2) * 60000 AS window_start, least(3, n - k * 2)::BIGINT AS n_ticks
    FROM (SELECT *, unnest(range(greatest(0, (p - 2) // 2), p // 2 + 1)) AS k FROM q)
    WHERE p >= k * 2 AND p < k * 2 + 3""",
)
def gap_aware_upper(spark, sf_dir):
    upper = F.unix_millis(F.lit("2024-01-15 12:30:59").cast("timestamp"))
    return windows.gap_aware(demo.sample_cells(spark, sf_dir), SPEC, upper=upper)


@query(
    "str12_app_windows",
    """WITH b AS (SELECT DISTINCT app_id, tick, tick // 60000 AS t FROM mcell),
    i AS (SELECT *, t - row_number() OVER (PARTITION BY app_id ORDER BY t) AS g FROM b),
    q AS (SELECT app_id, tick, t, row_number() OVER (PARTITION BY app_id, g ORDER BY t) - 1 AS p,
        count(*) OVER (PARTITION BY app_id, g) AS n, min(t) OVER (PARTITION BY app_id, g) AS t0 FROM i)
    SELECT app_id, tick, (t0 + k * 2) * 60000 AS window_start, least(3, n - k * 2)::BIGINT AS n_ticks
    FROM (SELECT *, unnest(range(greatest(0, (p - 2) // 2), p // 2 + 1)) AS k FROM q)
    WHERE p >= k * 2 AND p < k * 2 + 3""",
)
def app_windows(spark, sf_dir):
    return windows.gap_aware(demo.sample_cells(spark, sf_dir), SPEC, scope=["app_id"])


@query(
    "agg4_window_mean",
    """SELECT window_start, container_id, round(sum(memory) / max(n_ticks), 4) AS mean
    FROM mcell JOIN win USING (tick) GROUP BY ALL""",
)
def window_mean(spark, sf_dir):
    rows = features.pane_mean(demo.stored_cells(spark, sf_dir), SPEC, "memory")
    return rows.withColumn("mean", F.round("mean", 4))


_SLIDING = """
  b AS (SELECT DISTINCT tick, tick // 60000 AS t FROM mcell),
  i AS (SELECT tick, t, t - row_number() OVER (ORDER BY t) AS g FROM b),
  q AS (SELECT tick, t, row_number() OVER (PARTITION BY g ORDER BY t) - 1 AS p,
      count(*) OVER (PARTITION BY g) AS n, min(t) OVER (PARTITION BY g) AS t0 FROM i),
  sw AS (SELECT tick, (t0 + k) * 60000 AS window_start, least(60, n - k)::BIGINT AS n_ticks
      FROM (SELECT *, unnest(range(greatest(0, p - 59), p + 1)) AS k FROM q))"""


@query(
    "agg4_sliding_mean",
    f"""WITH {_SLIDING} SELECT window_start, container_id, round(sum(memory) / max(n_ticks), 4) AS mean
    FROM mcell JOIN sw USING (tick) GROUP BY ALL""",
)
def sliding_mean(spark, sf_dir):
    """Windows of an hour, one every minute: panes are single ticks."""
    rows = features.pane_mean(demo.stored_cells(spark, sf_dir), WindowSpec(60, 1, demo.MINUTE), "memory")
    return rows.withColumn("mean", F.round("mean", 4))


@query(
    "udf4_extractor",
    """SELECT window_start, container_id, round(sum(memory) / max(n_ticks), 4) AS value
    FROM mcell JOIN win USING (tick) GROUP BY ALL""",
)
def extractor(spark, sf_dir):
    stored = demo.stored_cells(spark, sf_dir)
    return features.run_extractor("memory", stored, SPEC).withColumn("value", F.round("value", 4))


@query(
    "agg5_window_key_counts",
    """WITH log AS (SELECT us // 1000 + 7200000 AS ms, container_id, name FROM cf WHERE type = 'period'),
    n AS (SELECT ms - ms % 60000 AS tick, container_id, name AS key, count(*)::BIGINT AS n FROM log GROUP BY ALL),
    l AS (SELECT window_start, container_id, max(tick) AS tick FROM mcell JOIN win USING (tick) GROUP BY ALL)
    SELECT window_start, container_id, tick, key, n FROM l JOIN n USING (tick, container_id)""",
)
def window_key_counts(spark, sf_dir):
    counts = cells.message_counts(demo.task_messages(spark, sf_dir, demo.MINUTE))
    return features.pane_key_counts(demo.stored_cells(spark, sf_dir), counts, SPEC)


@query(
    "win4_positional",
    """WITH s AS (SELECT event_type AS source, value, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS p,
        count(*) OVER (PARTITION BY event_type) AS n FROM ev),
    b AS (SELECT *, CASE WHEN n < 6 THEN 0 ELSE (n - 6) // 5 + 1 END AS last FROM s),
    w AS (SELECT source, p, value, unnest(range(0, last + 1)) AS k FROM b WHERE false
        UNION ALL SELECT source, p, value, unnest(range(greatest(0, (p - 5) // 5), least(last, p // 5) + 1)) FROM b)
    SELECT source, k AS window_no, round(sum(value), 4) AS total, max(value) AS top FROM w
    WHERE p >= k * 5 AND p < k * 5 + 6 GROUP BY ALL""",
)
def positional(spark, sf_dir):
    rows = demo.events(spark, sf_dir).withColumn("source", F.col("event_type"))
    return windows.positional(
        rows,
        segments.micros(),
        ["ts", "event_id"],
        6,
        5,
        ["source"],
        [F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top")],
    )


@query(
    "agg8_positional_reducers",
    """WITH s AS (SELECT container_id, value, row_number() OVER (PARTITION BY container_id ORDER BY us, event_id) - 1 AS p,
        count(*) OVER (PARTITION BY container_id) AS n FROM ev),
    b AS (SELECT *, CASE WHEN n < 4 THEN 0 ELSE (n - 4) // 2 + 1 END AS last FROM s),
    w AS (SELECT container_id, p, value, unnest(range(greatest(0, (p - 3) // 2), least(last, p // 2) + 1)) AS k FROM b)
    SELECT container_id, k AS window_no, round(avg(value), 4) AS w_avg, max(value) AS w_max, min(value) AS w_min,
      round(max(value) - min(value), 4) AS w_delta, round(sum(value), 4) AS w_sum, count(*)::BIGINT AS w_count
    FROM w WHERE p >= k * 2 AND p < k * 2 + 4 GROUP BY ALL""",
)
def positional_reducers(spark, sf_dir):
    return _reduced(spark, sf_dir, 4, 2)


@query(
    "agg8_long_windows",
    """WITH s AS (SELECT user_id % 10 AS app, value, row_number() OVER (PARTITION BY user_id % 10 ORDER BY us, event_id) - 1 AS p,
        count(*) OVER (PARTITION BY user_id % 10) AS n FROM ev),
    b AS (SELECT *, CASE WHEN n < 60 THEN 0 ELSE n - 59 END AS last FROM s)
    SELECT app, p AS window_no, round(avg(value) OVER w, 4) AS w_avg, max(value) OVER w AS w_max, min(value) OVER w AS w_min,
      round(max(value) OVER w - min(value) OVER w, 4) AS w_delta, round(sum(value) OVER w, 4) AS w_sum, count(*) OVER w AS w_count
    FROM b WINDOW w AS (PARTITION BY app ORDER BY p ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) QUALIFY p <= last""",
)
def long_windows(spark, sf_dir):
    """Sixty events, one on at a time: each row goes on twice, not sixty times."""
    return _reduced(spark, sf_dir, 60, 1, (F.col("user_id") % 10).alias("app"))


def _reduced(spark, sf_dir, size, stride, scope=None):
    scope = F.col("container_id") if scope is None else scope
    rows = stage(demo.events(spark, sf_dir).select(scope, "ts", "event_id", "value"))
    how = {f"w_{h}": (h, "value") for h in windows.MERGED}
    order, name = ["ts", "event_id"], rows.columns[0]
    out = windows.positional_reduce(rows, segments.micros(), order, size, stride, [name], how)
    return out.withColumns({c: F.round(c, 4) for c in ("w_avg", "w_delta", "w_sum")})


_COUNTERS = """c AS (SELECT event_id, container_id, us, (event_id * 7) % 1009 + event_id * 3 AS used,
    event_id * 10 + user_id AS total, CASE WHEN event_type = 'error' THEN 0 ELSE event_id * 1000 END AS bytes FROM ev)"""


def _counters(spark, sf_dir):
    e = F.col("event_id")
    return demo.events(spark, sf_dir).select(
        "event_id",
        "container_id",
        "ts",
        (e * 7 % 1009 + e * 3).alias("used"),
        (e * 10 + F.col("user_id")).alias("total"),
        F.when(F.col("event_type") == "error", 0).otherwise(e * 1000).alias("bytes"),
    )


@query(
    "win5_cpu_ratio",
    f"""WITH {_COUNTERS}, d AS (SELECT event_id, used - lag(used) OVER w AS du, total - lag(total) OVER w AS dt
        FROM c WINDOW w AS (PARTITION BY container_id ORDER BY us))
    SELECT event_id, round(CASE WHEN du IS NULL THEN 0.0 ELSE greatest(0.0, du::DOUBLE / dt) END, 9) AS rate FROM d""",
)
def cpu_ratio(spark, sf_dir):
    rows = metrics.counter_ratio(_counters(spark, sf_dir), "used", "total", "container_id", "ts")
    return rows.select("event_id", F.round("rate", 9).alias("rate"))


@query(
    "win6_byte_rates",
    f"""WITH {_COUNTERS}, d AS (SELECT event_id, used - lag(used) OVER w AS du, total - lag(total) OVER w AS dt,
        (us - lag(us) OVER w) / 1000000.0 AS sec FROM c WINDOW w AS (PARTITION BY container_id ORDER BY us))
    SELECT event_id, round(coalesce(du / sec / 1000, 0.0), 9) AS used_rate,
      round(coalesce(dt / sec / 1000, 0.0), 9) AS total_rate FROM d""",
)
def byte_rates(spark, sf_dir):
    rows = metrics.counter_rate(_counters(spark, sf_dir), ["used", "total"], "container_id", "ts")
    return rows.select("event_id", F.round("used_rate", 9).alias("used_rate"), F.round("total_rate", 9).alias("total_rate"))


@query(
    "win7_baseline",
    f"""WITH {_COUNTERS}, b AS (SELECT event_id, bytes, first_value(nullif(bytes, 0) IGNORE NULLS) OVER
        (PARTITION BY container_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM c)
    SELECT event_id, bytes - coalesce(o, 0) AS net FROM b""",
)
def baseline(spark, sf_dir):
    rows = metrics.baseline(_counters(spark, sf_dir), "bytes", "container_id", "ts", "net")
    return rows.select("event_id", "net")


@query(
    "win8_metric_delta",
    """SELECT tick, container_id, memory - coalesce(lag(memory) OVER (PARTITION BY container_id ORDER BY tick), 0) AS delta
    FROM mcell""",
)
def metric_delta(spark, sf_dir):
    rows = features.metric_delta(demo.stored_cells(spark, sf_dir), "memory", width=demo.HOUR)
    return rows.select("tick", "container_id", "delta")


@query(
    "win9_key_range",
    """SELECT container_id, min(tick) AS first_tick, max(tick) AS last_tick FROM htick
    GROUP BY container_id HAVING count(DISTINCT tick) > 1""",
)
def key_range(spark, sf_dir):
    return features.key_range(demo.task_messages(spark, sf_dir, demo.HOUR), "task")


@query(
    "win10_zero_fill",
    """WITH r AS (SELECT container_id, us, value FROM ev WHERE event_type <> 'signup'),
    f AS (SELECT container_id, min(us) AS first FROM r GROUP BY container_id),
    s AS (SELECT container_id, min(us) AS start FROM ev GROUP BY container_id)
    SELECT container_id, us, value, false AS filled FROM r
    UNION ALL
    SELECT container_id, us, 0.0, true FROM (SELECT s.container_id, first, unnest(range(0, 10)) * 1000000 + start AS us
      FROM s LEFT JOIN f ON s.container_id = f.container_id) WHERE first IS NULL OR us < first""",
)
def zero_fill(spark, sf_dir):
    """Readings start after the container: its first signup events stand for the wait."""
    rows = demo.events(spark, sf_dir)
    readings = rows.where(F.col("event_type") != "signup")
    starts = rows.groupBy("container_id").agg(F.min("ts").alias("ts"))
    filled = metrics.zero_fill_leading(readings, starts, ["value"])
    return filled.select("container_id", _us().alias("us"), "value", "filled")


@query(
    "str8_idle_sessions",
    """WITH s AS (SELECT us, CASE WHEN us - lag(us) OVER (ORDER BY us) >= 300000000 THEN 1 ELSE 0 END AS new FROM ev),
    g AS (SELECT us, sum(new) OVER (ORDER BY us) AS g FROM s)
    SELECT min(us) AS start_us, max(us) AS end_us, count(*)::BIGINT AS n_rows FROM g GROUP BY g""",
)
def idle_sessions(spark, sf_dir):
    rows = windows.idle_sessions(demo.events(spark, sf_dir), 300_000)
    return rows.select(_us("session_start").alias("start_us"), _us("session_end").alias("end_us"), "n_rows")


@query(
    "str8_container_sessions",
    """WITH s AS (SELECT container_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY container_id ORDER BY us)
        >= 21600000000 THEN 1 ELSE 0 END AS new FROM ev),
    g AS (SELECT container_id, us, sum(new) OVER (PARTITION BY container_id ORDER BY us) AS g FROM s)
    SELECT container_id, min(us) AS start_us, max(us) AS end_us, count(*)::BIGINT AS n_rows
    FROM g GROUP BY container_id, g""",
)
def container_sessions(spark, sf_dir):
    rows = windows.idle_sessions(demo.events(spark, sf_dir), 6 * demo.HOUR, ["container_id"])
    return rows.select(
        "container_id", _us("session_start").alias("start_us"), _us("session_end").alias("end_us"), "n_rows"
    )


_FLUSHABLE = """
  c AS (SELECT app_id, max(tick) AS last_tick FROM mcell GROUP BY app_id),
  o AS (SELECT app_id, min(us) // 1000 AS ms FROM rm WHERE name = 'app.state' AND value > 6.5 GROUP BY app_id),
  fl AS (SELECT c.app_id, greatest(last_tick, ms) AS last_tick FROM c JOIN o USING (app_id)
      WHERE greatest(last_tick, ms) + 2000 <= epoch_ms(TIMESTAMP '2024-01-30 23:20:00'))"""


def _flushable(spark, sf_dir, stored):
    finished = states.finished_apps(demo.manager_facts(spark, sf_dir, "rm"))
    horizon = F.unix_millis(F.lit("2024-01-30 23:20:00").cast("timestamp"))
    return flows.flushable_apps(stored, finished, 2000, horizon)


@query("str9_app_flush", f"WITH {_FLUSHABLE} SELECT app_id, last_tick FROM fl")
def app_flush(spark, sf_dir):
    return _flushable(spark, sf_dir, demo.stored_cells(spark, sf_dir))


@query(
    "snk6_app_cells",
    f"WITH {_FLUSHABLE} SELECT tick, container_id, app_id, memory FROM mcell WHERE app_id IN (SELECT app_id FROM fl)",
)
def app_cells(spark, sf_dir):
    stored = demo.stored_cells(spark, sf_dir)
    kept = snapshots.app_cells(stored, _flushable(spark, sf_dir, stored))
    return kept.select("tick", "container_id", "app_id", "memory")


@query(
    "src7_merge_snapshots",
    """WITH s AS (SELECT ms - ms % 3600000 AS tick, container_id, user_id % 3 AS n, max(event_id) AS v FROM ev GROUP BY ALL)
    SELECT tick, container_id, v FROM s WHERE n = (SELECT max(n) FROM s b WHERE b.tick = s.tick)""",
)
def merge_snapshots(spark, sf_dir):
    """Three snapshots of the same hours; the highest number wins an hour as a whole."""
    rows = demo.events(spark, sf_dir).groupBy(
        windows.tick(F.unix_millis("ts"), demo.HOUR).alias("tick"), "container_id", (F.col("user_id") % 3).alias("n")
    ).agg(F.max("event_id").alias("v"))
    return logs.merge_snapshots(rows, F.col("n")).select("tick", "container_id", "v")


@query(
    "src7_json_snapshots",
    """WITH s AS (SELECT ms - ms % 3600000 AS tick, container_id, app_id, user_id % 3 AS n, max(value) AS memory,
        max_by(event_id, (us, event_id)) AS last FROM ev GROUP BY ALL)
    SELECT tick, container_id, app_id, memory, 'k' || (last % 2) AS key, last::VARCHAR AS tid, last + 0.5 AS value
    FROM s WHERE n = (SELECT max(n) FROM s b WHERE b.tick = s.tick)""",
)
def json_snapshots(spark, sf_dir):
    """Three JSON snapshots and what a reload of the store gives: cells, and the messages in their maps."""
    rows = demo.events(spark, sf_dir).groupBy(
        windows.tick(F.unix_millis("ts"), demo.HOUR).alias("tick"), "container_id", "app_id", (F.col("user_id") % 3).alias("n")
    ).agg(F.max("value").alias("memory"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))
    key = F.concat(F.lit("k"), (F.col("last") % 2).cast("string"))
    ids = F.create_map(F.lit("TID"), F.col("last").cast("string"))
    message = F.struct(key.alias("key"), ids.alias("identifiers"), (F.col("last") + 0.5).alias("value"))
    maps = {"period_messages": F.create_map(key, F.array(message)), "instant_messages": F.lit(None).cast("map<string, array<struct<key:string, identifiers:map<string,string>, value:double>>>")}
    rest = [c for c in logs.SNAPSHOT_FIELDS.values() if c not in (*rows.columns, *maps)]
    rows = stage(rows.withColumns({**maps, **{c: F.lit(0.25) for c in rest}}))
    folder = new_folder(spark)
    for n in range(3):
        snapshots.write_snapshot(rows.where(F.col("n") == n).drop("n", "last"), folder, "json")
    store = stage(logs.read_store(spark, folder))  # read several times below: its text is parsed here once
    merged = logs.merge_snapshots(store, logs.snapshot_number(F.col("source")))
    messages = logs.snapshot_messages(merged).select(*cells.CELL, "key", F.col("identifiers")["TID"].alias("tid"), "value")
    return merged.select(*cells.CELL, "app_id", "memory").join(messages, cells.CELL)


@query(
    "ord1_tick_order",
    "SELECT tick, container_id, row_number() OVER (ORDER BY tick, container_id) - 1 AS place FROM hcell",
)
def tick_order(spark, sf_dir):
    """Cells numbered in order of tick, as a number, and container; a crowded tick is cut by container."""
    hourly = demo.stored_cells(spark, sf_dir, demo.HOUR).select(*cells.CELL)
    cut = {"width": 24 * demo.HOUR, "minor": "container_id"}
    return segments.running_count(hourly, [], F.col("tick"), list(cells.CELL), F.lit(True), "place", **cut)


@query(
    "win2_options",
    """SELECT tick, (t0 + k * 4) * 60000 AS window_start, least(4, n - k * 4) AS n_ticks, 'cut stride' AS options
    FROM (SELECT *, p // 4 AS k FROM pos)
    UNION ALL
    SELECT tick, (t0 + k * 1000) * 60000, least(1000, n - k * 1000), 'short without ms' FROM (SELECT *, p // 1000 AS k FROM pos)""",
)
def window_options(spark, sf_dir):
    """Windows by options that are not taken as given: a stride above the length, a length below 1000 without ms resolution."""
    stored = demo.stored_cells(spark, sf_dir)
    specs = {
        "cut stride": WindowSpec.from_options(4, 9, demo.MINUTE, ms_resolution=True),
        "short without ms": WindowSpec.from_options(4, 2, demo.MINUTE),
    }
    out = None
    for name, spec in specs.items():
        one = windows.gap_aware(stored, spec).withColumn("options", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_ARRIVAL = 21_600_000_000


@query(
    "str5_late_rows",
    f"""WITH a AS (SELECT event_id, us, us // {_ARRIVAL} + CASE WHEN event_id % 11 = 0 THEN 3 ELSE 0 END AS batch FROM ev),
    m AS (SELECT batch, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
      FROM a GROUP BY batch)
    SELECT event_id, batch, coalesce(us < latest - 43200000000, false) AS is_late FROM a JOIN m USING (batch)""",
)
def late_rows(spark, sf_dir):
    """Events in quarters of days, every eleventh three quarters late: those beyond half a day are told apart."""
    quarter = F.floor(_us() / _ARRIVAL) + F.when(F.col("event_id") % 11 == 0, 3).otherwise(0)
    rows = stage(demo.events(spark, sf_dir).select("event_id", "ts", quarter.alias("batch")))
    return windows.flag_late(rows, "batch", 12 * demo.HOUR).select("event_id", "batch", "is_late")


@query(
    "src3_since",
    """SELECT event_id, part FROM (SELECT event_id, us, unnest(['line', 'at', 'by']) AS part FROM ev)
    WHERE us >= epoch_us(TIMESTAMP '2024-01-20 12:00:00')""",
)
def since(spark, sf_dir):
    """A daemon log with a stack trace of two undated lines behind each line, read from a time on."""
    e = F.col("event_id").cast("string")
    text = F.concat(F.col("ts_text"), F.lit(" ERROR line "), e, F.lit("\n\tat at "), e, F.lit("\n\tby by "), e)
    folder = new_folder(spark)
    demo.events(spark, sf_dir).select(text.alias("value")).write.text(folder)
    kept = logs.read_daemon_log(spark, folder, "nodemanager", since="2024-01-20 12:00:00")
    part, number = (F.regexp_extract("line", r"(line|at|by) (\d+)$", k) for k in (1, 2))
    return kept.select(number.cast("bigint").alias("event_id"), part.alias("part"))
