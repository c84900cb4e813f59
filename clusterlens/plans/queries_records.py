"""Queries on records, lines, samples and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterlens.functions import ids
from clusterlens.operators import cells, extract, metrics, periods, segments, states
from clusterlens.plans import demo, flows
from clusterlens.plans.catalog import query
from clusterlens.plans.oracle import state_code
from clusterlens.plans.oracle import CONTAINER_STATES
from clusterlens.session import stage
from clusterlens.sinks import records as sinks
from clusterlens.sources import bundled, logs
from clusterlens.streaming.queries import latency


def _us(column: str = "ts"):
    return F.unix_micros(column)


@query("prj1_route", "SELECT seq, route FROM routed")
def route(spark, sf_dir):
    return demo.routed(spark, sf_dir).select("seq", "route")


@query(
    "prj2_rejects",
    """SELECT seq, key, value FROM routed
    WHERE route = 'unrecognized'
      OR (route = 'container_log' AND NOT starts_with(value, 'container'))
    UNION ALL
    SELECT seq, key, value FROM fields WHERE len(f) < 10 OR try_cast(f[3] AS DOUBLE) IS NULL""",
)
def rejects(spark, sf_dir):
    routed = demo.routed(spark, sf_dir)
    bad_metrics = metrics.rejected_lines(routed.drop("ts").where(F.col("route") == "metric"))
    return extract.rejects(routed.drop("ts")).unionByName(bad_metrics).select("seq", "key", "value")


@query("prj3_matching_lines", "SELECT seq, line FROM lines")
def matching_lines(spark, sf_dir):
    lines = demo.container_lines(spark, sf_dir)
    return extract.matching_lines(lines, bundled.DEFAULT.container).select("seq", "line")


@query(
    "prj3_matching_documents",
    r"""SELECT container_id, seq FROM (
      SELECT 'container_doc_' || doc_id AS container_id, doc_id * 100000 + i - 1 AS seq, l[i] AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
              unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
    WHERE regexp_full_match(line, '\w+ (?:the|of) .*')
      OR regexp_full_match(line, '.*\s[0-9]+\s?[A-Za-z]*.*')
      OR regexp_full_match(line, '.*[a-z0-9.]+@[a-z0-9.]+.*')""",
)
def matching_documents(spark, sf_dir):
    lines = demo.document_lines(spark, sf_dir)
    return extract.matching_lines(lines, demo.PROSE_RULES).select("container_id", "seq")


@query("prj4_split_line", "SELECT seq, container_id, line FROM lines")
def split_line(spark, sf_dir):
    return demo.container_lines(spark, sf_dir).select("seq", "container_id", "line")


@query(
    "prj5_metric_parse",
    """SELECT seq, container_id, ms, cpu, memory, disk_service_byte, disk_service_time, disk_wait_time,
      disk_io_time, round(net_rate, 6) AS net_rate FROM smp""",
)
def metric_parse(spark, sf_dir):
    return demo.samples(spark, sf_dir).select(
        "seq",
        "container_id",
        F.unix_millis("ts").alias("ms"),
        "cpu",
        "memory",
        "disk_service_byte",
        "disk_service_time",
        "disk_wait_time",
        "disk_io_time",
        F.round("net_rate", 6).alias("net_rate"),
    )


@query(
    "prj6_metric_tags",
    """SELECT seq, CASE WHEN len(f) > 10 THEN substr(f[13], 6) END AS host,
      CASE WHEN len(f) > 10 THEN 'z' END AS zone, CASE WHEN len(f) > 10 THEN 4 ELSE 2 END AS n FROM smp""",
)
def metric_tags(spark, sf_dir):
    return demo.samples(spark, sf_dir).select(
        "seq",
        F.col("tags")["host"].alias("host"),
        F.col("tags")["zone"].alias("zone"),
        F.size("tags").cast("bigint").alias("n"),
    )


@query(
    "prj7_unpivot",
    """SELECT seq, unnest(['cpu','memory','disk.service.byte','disk.service.time','disk.wait.time','diskIOTime',
      'network']) AS metric, round(unnest([cpu, memory, disk_service_byte, disk_service_time, disk_wait_time,
      disk_io_time, net_rate]), 6) AS value FROM smp""",
)
def unpivot(spark, sf_dir):
    return metrics.unpivot(demo.samples(spark, sf_dir)).select(
        "seq", "metric", F.round("value", 6).alias("value")
    )


@query(
    "prj8_valid_container",
    "SELECT seq, container_id FROM smp WHERE len(f) = 10",
)
def valid_container(spark, sf_dir):
    """Samples whose container is named; those with a host tag lose their name here."""
    host = F.col("tags")["host"]
    rows = demo.samples(spark, sf_dir).withColumn(
        "container_id",
        F.when(host == "g0", F.lit(None))
        .when(host == "g1", F.lit("null"))
        .otherwise(F.col("container_id")),
    )
    return cells.valid_container(rows).select("seq", "container_id")


@query(
    "prj9_container_or_app",
    """SELECT seq, coalesce(container_id, app_id) AS container_id, name FROM rm
       UNION ALL SELECT seq, container_id, name FROM nm""",
)
def container_or_app(spark, sf_dir):
    rows = demo.manager_facts(spark, sf_dir, "rm").unionByName(demo.manager_facts(spark, sf_dir, "nm"))
    return cells.container_or_app(rows).select("seq", "container_id", "name")


@query(
    "prj11_keys",
    """SELECT seq, type || ':' || name AS key, type, name FROM cf
       UNION ALL SELECT seq, 'plain', NULL, 'plain' FROM nm""",
)
def keys(spark, sf_dir):
    qualified = demo.container_facts(spark, sf_dir).select(
        "seq", extract.qualify(F.col("type"), F.col("name")).alias("key")
    )
    plain = demo.manager_facts(spark, sf_dir, "nm").select("seq", F.lit("plain").alias("key"))
    type_, name = extract.unqualify(F.col("key"))
    return qualified.unionByName(plain).select("seq", "key", type_.alias("type"), name.alias("name"))


@query(
    "prj12_identifiers",
    """SELECT seq, rule_id, group_id, tag, tag_value FROM cf""",
)
def identifiers(spark, sf_dir):
    rows = demo.container_facts(spark, sf_dir).select(
        "seq", "rule_id", "group_id", cells.identifiers(F.col("tags")).alias("i")
    )
    return rows.select(
        "seq", "rule_id", "group_id", F.explode_outer("i").alias("tag", "tag_value")
    )


@query(
    "prj13_short_ids",
    """SELECT seq, string_split(container_id, '_')[4] || '_' || string_split(container_id, '_')[5] AS container,
      string_split(container_id, '_')[2] || '_' || string_split(container_id, '_')[3] AS app FROM smp""",
)
def short_ids(spark, sf_dir):
    tags = ids.short_tags(F.col("tags"))
    return demo.samples(spark, sf_dir).select(
        "seq", tags["container"].alias("container"), tags["app"].alias("app")
    )


@query(
    "prj14_id_tags",
    "SELECT seq, rule_id, group_id, container_id AS container, app_id AS app FROM cf",
)
def id_tags(spark, sf_dir):
    rows = demo.container_facts(spark, sf_dir)
    bare = rows.withColumn("tags", cells.identifiers(F.col("tags")))
    return extract.with_ids(bare).select(
        "seq", "rule_id", "group_id", F.col("tags")["container"].alias("container"), F.col("tags")["app"].alias("app")
    )


@query(
    "jon1_container_facts",
    """SELECT seq, rule_id, group_id, container_id, app_id, us, type, name, tag_value,
      round(value, 6) AS value, is_finish FROM cf""",
)
def container_facts(spark, sf_dir):
    tags = F.col("tags")
    return demo.container_facts(spark, sf_dir).select(
        "seq",
        "rule_id",
        "group_id",
        "container_id",
        "app_id",
        _us().alias("us"),
        "type",
        "name",
        F.coalesce(tags["stageID"], tags["TID"]).alias("tag_value"),
        F.round("value", 6).alias("value"),
        "is_finish",
    )


_WORD = r"(?P<word>\w+) (?:the|of) .*"
_NUMBER = r".*\s(?P<number>[0-9]+)\s?(?P<unit>[A-Za-z]*).*"
_MAIL = r".*(?P<email>[a-z0-9.]+@[a-z0-9.]+).*"
_DOCUMENT_LINES = """(SELECT 'container_doc_' || doc_id AS container_id, doc_id * 100000 + i - 1 AS seq, l[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l,
          unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


@query(
    "jon1_document_facts",
    f"""SELECT seq, 0 AS rule_id, regexp_extract(line, '{_WORD}', 1) AS tag_value, 1.0 AS value
    FROM {_DOCUMENT_LINES} WHERE regexp_full_match(line, '{_WORD}')
    UNION ALL
    SELECT seq, 1, regexp_extract(line, '{_NUMBER}', 2), regexp_extract(line, '{_NUMBER}', 1)::DOUBLE
    FROM {_DOCUMENT_LINES} WHERE regexp_full_match(line, '{_NUMBER}')
    UNION ALL
    SELECT seq, 2, regexp_extract(line, '{_MAIL}', 1), 1.0
    FROM {_DOCUMENT_LINES} WHERE regexp_full_match(line, '{_MAIL}')""",
)
def document_facts(spark, sf_dir):
    """Prose lines under a log time stamp, so that the rules apply to whole real texts."""
    stamped = demo.document_lines(spark, sf_dir).withColumn(
        "line", F.concat(F.lit("2024-01-01 00:00:00 "), "line")
    )
    rules = [
        type(r)(r"\S+ \S+ (?:" + r.regex + ")", r.groups, r.date_offset) for r in demo.PROSE_RULES
    ]
    tags = F.col("tags")
    return extract.apply_rules(stamped, rules).select(
        "seq",
        "rule_id",
        F.coalesce(tags["word"], tags["unit"], tags["email"]).alias("tag_value"),
        "value",
    )


@query("jon2_nm_facts", "SELECT seq, container_id, us, name, value FROM nm")
def nm_facts(spark, sf_dir):
    return demo.manager_facts(spark, sf_dir, "nm").select(
        "seq", "container_id", _us().alias("us"), "name", "value"
    )


@query("jon3_rm_facts", "SELECT seq, name, app_id, attempt, container_id, us, value FROM rm")
def rm_facts(spark, sf_dir):
    return demo.manager_facts(spark, sf_dir, "rm").select(
        "seq",
        "name",
        "app_id",
        F.col("tags")["app.attempt"].alias("attempt"),
        "container_id",
        _us().alias("us"),
        "value",
    )


@query(
    "jon6_state_events",
    r"""SELECT regexp_extract(value, 'Start request for (container\S*)', 1) AS container_id, 'NEW' AS state,
      epoch_us(substr(value, 1, 23)::TIMESTAMP) AS us, seq
    FROM routed WHERE route = 'nm_log' AND value LIKE '%Start request for container%'
    UNION ALL
    SELECT regexp_extract(value, 'Container (\S+) transitioned', 1), regexp_extract(value, ' to (\S+)$', 1),
      epoch_us(substr(value, 1, 23)::TIMESTAMP), seq
    FROM routed WHERE route = 'nm_log' AND value LIKE '%transitioned from%'""",
)
def state_events(spark, sf_dir):
    rows = states.state_events(demo.daemon_lines(spark, sf_dir, "nm"))
    return rows.select("container_id", "state", _us().alias("us"), "seq")


@query(
    "jon4_state_codes",
    f"""SELECT seq, {state_code(CONTAINER_STATES, "regexp_extract(value, ' to (.*)$', 1)")} AS code
    FROM routed WHERE route = 'nm_log' AND value LIKE '%transitioned from%'""",
)
def state_codes(spark, sf_dir):
    lines = demo.daemon_lines(spark, sf_dir, "nm").where(F.col("line").contains("transitioned from"))
    state = F.regexp_extract("line", r" to (.*)$", 1)
    return lines.select("seq", states.states.state_code("container", state).alias("code"))


@query(
    "jon5_state_as_of",
    """WITH probes AS (SELECT event_id, container_id, us FROM ev WHERE event_type = 'view'),
    st AS (SELECT container_id, us, event_id,
             (['NEW','LOCALIZED','RUNNING','KILLING','DONE'])[event_id % 5 + 1] AS state
           FROM ev WHERE event_type = 'error')
    SELECT p.event_id, p.container_id, coalesce(s.state, 'NEW') AS state
    FROM probes p ASOF LEFT JOIN st s ON p.container_id = s.container_id AND p.us >= s.us""",
)
def state_as_of(spark, sf_dir):
    rows = demo.events(spark, sf_dir)
    names = F.array(*[F.lit(s) for s in ("NEW", "LOCALIZED", "RUNNING", "KILLING", "DONE")])
    timeline = rows.where(F.col("event_type") == "error").select(
        "container_id",
        "ts",
        F.col("event_id").alias("seq"),
        F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("state"),
    )
    probes = rows.where(F.col("event_type") == "view").select(
        "event_id", "container_id", "ts", F.col("event_id").alias("seq")
    )
    return states.state_as_of(probes, timeline).select("event_id", "container_id", "state")


_PAIRED = """
marked AS (
  SELECT container_id, tag_value AS tid, us, seq, CASE WHEN is_finish THEN 'f' ELSE 's' END AS kind
  FROM cf WHERE name = 'task'
  UNION ALL
  SELECT k.container_id, k.tid, m.us, m.seq, 'x' FROM fin m
  JOIN (SELECT DISTINCT container_id, tag_value AS tid FROM cf WHERE name = 'task') k
    ON k.container_id = m.container_id),
flagged AS (
  SELECT *, lag(kind) OVER w AS before,
    first_value(CASE WHEN kind <> 's' THEN us END IGNORE NULLS) OVER f AS end_us,
    first_value(CASE WHEN kind <> 's' THEN kind END IGNORE NULLS) OVER f AS end_kind
  FROM marked
  WINDOW w AS (PARTITION BY container_id, tid ORDER BY us, seq),
    f AS (PARTITION BY container_id, tid ORDER BY us, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
paired AS (
  SELECT container_id, tid, us AS start_us, end_us,
    CASE end_kind WHEN 'f' THEN 'finish' WHEN 'x' THEN 'container_finish' ELSE 'open' END AS closed_by
  FROM flagged WHERE kind = 's' AND before IS DISTINCT FROM 's')
"""


@query(
    "jon7_periods",
    f"WITH {_PAIRED} SELECT container_id, tid, start_us, end_us, closed_by FROM paired",
)
def period_pairs(spark, sf_dir):
    paired = periods.pair(demo.stored_facts(spark, sf_dir), demo.stored_finishes(spark, sf_dir))
    return paired.select(
        "container_id",
        F.col("tags")["TID"].alias("tid"),
        _us("start_ts").alias("start_us"),
        _us("end_ts").alias("end_us"),
        "closed_by",
    )


@query(
    "str2_period_ticks",
    f"""WITH {_PAIRED},
    grid AS (SELECT *, (start_us + 3599999999) // 3600000000 AS lo,
        (end_us + 3599999999) // 3600000000 - 1 AS last,
        (1706659200000000) // 3600000000 AS now FROM paired),
    span AS (SELECT *, CASE closed_by WHEN 'finish' THEN greatest(lo, last)
        WHEN 'container_finish' THEN last ELSE now END AS hi FROM grid)
    SELECT container_id, tid, unnest(range(lo, hi + 1)) * 3600000 AS ms, 1.0 AS value
    FROM span WHERE hi >= lo""",
)
def period_ticks(spark, sf_dir):
    """Running tasks per hour, up to 2024-01-31."""
    paired = periods.pair(demo.stored_facts(spark, sf_dir), demo.stored_finishes(spark, sf_dir))
    horizon = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return periods.expand(paired, demo.HOUR, horizon).select(
        "container_id", F.col("tags")["TID"].alias("tid"), F.unix_millis("ts").alias("ms"), "value"
    )


@query(
    "jon8_new_app_containers",
    """SELECT DISTINCT container_id, app_id FROM ev WHERE app_id IN (
      SELECT app_id FROM ev GROUP BY app_id HAVING min(us) >= epoch_us(TIMESTAMP '2024-01-01 00:30:00'))""",
)
def new_app_containers(spark, sf_dir):
    rows = demo.events(spark, sf_dir)
    since = F.lit("2024-01-01 00:30:00").cast("timestamp")
    fresh = logs.containers_of_new_apps(
        rows.select("container_id").distinct(), rows.select("app_id", "ts"), since
    )
    return fresh.select("container_id", "app_id")


@query(
    "jon10_live_info",
    """WITH r AS (SELECT container_id, us, event_id, event_type = 'signup' AS fin,
        CASE WHEN event_type <> 'signup' THEN 'k ' || (event_id % 3) END AS v FROM ev),
    c AS (SELECT *, lag(v) OVER (PARTITION BY container_id ORDER BY us, event_id) AS b FROM r),
    t AS (SELECT container_id, max_by(coalesce(v, ''), us) AS v,
        max(CASE WHEN v IS DISTINCT FROM b THEN us END) AS us FROM c GROUP BY container_id)
    SELECT container_id, 'info:' || replace(v, ' ', '_') AS info, us FROM t WHERE v <> ''""",
)
def live_info(spark, sf_dir):
    rows = demo.events(spark, sf_dir).select(
        "container_id",
        F.lit("info").alias("name"),
        F.concat(F.lit("k "), (F.col("event_id") % 3).cast("string")).alias("value_text"),
        (F.col("event_type") == "signup").alias("is_finish"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    return states.live_info(rows).select("container_id", "info", _us().alias("us"))


@query(
    "agg9_finished_apps",
    """SELECT app_id, min(us) AS us FROM rm WHERE name = 'app.state' AND value > 6.5 GROUP BY app_id""",
)
def finished_apps(spark, sf_dir):
    rows = states.finished_apps(demo.manager_facts(spark, sf_dir, "rm"))
    return rows.select("app_id", _us("finished_at").alias("us"))


@query(
    "snk1_log_messages",
    """SELECT container_id || '-log' AS key, container_id || ' ' || line AS value FROM lines
    UNION ALL SELECT 'nodemanager-log', value FROM routed WHERE route = 'nm_log'""",
)
def log_messages(spark, sf_dir):
    container = sinks.to_log_messages(demo.container_lines(spark, sf_dir))
    daemon = demo.daemon_lines(spark, sf_dir, "nm").withColumn("source", F.lit("nodemanager"))
    return container.unionByName(sinks.to_log_messages(daemon))


@query(
    "snk2_metric_messages",
    """SELECT f[1] || '-metric' AS key, concat_ws(',', f[1], f[2], cpu, memory, disk_service_byte,
      disk_service_time, disk_wait_time, disk_io_time, f[9]::DOUBLE, f[10]::DOUBLE) AS value FROM smp""",
)
def metric_messages(spark, sf_dir):
    return sinks.to_metric_messages(demo.samples(spark, sf_dir))


@query(
    "snk3_points",
    """SELECT name AS metric, us // 1000 AS timestamp, round(value, 6) AS value,
      string_split(container_id, '_')[4] || '_' || string_split(container_id, '_')[5] AS container,
      string_split(container_id, '_')[2] || '_' || string_split(container_id, '_')[3] AS app, tag_value FROM cf""",
)
def points(spark, sf_dir):
    facts = demo.container_facts(spark, sf_dir)
    keyed = facts.withColumn("key", extract.qualify(F.col("type"), F.col("name")))
    tags = F.col("tags")
    return sinks.valid_points(sinks.to_points(keyed)).select(
        "metric",
        "timestamp",
        F.round("value", 6).alias("value"),
        tags["container"].alias("container"),
        tags["app"].alias("app"),
        F.coalesce(tags["stageID"], tags["TID"]).alias("tag_value"),
    )


@query(
    "snk3_payloads",
    """SELECT name AS metric, us // 1000 AS timestamp, round(value, 6) AS value,
      string_split(container_id, '_')[4] || '_' || string_split(container_id, '_')[5] AS container,
      string_split(container_id, '_')[2] || '_' || string_split(container_id, '_')[3] AS app, tag_value FROM cf""",
)
def payloads(spark, sf_dir):
    """Points packed into JSON arrays, unpacked again; the packing depends on partitions, the points do not."""
    facts = demo.container_facts(spark, sf_dir)
    keyed = facts.withColumn("key", extract.qualify(F.col("type"), F.col("name")))
    packed = sinks.payloads(sinks.to_points(keyed))
    point = "array<struct<metric: string, timestamp: bigint, value: double, tags: map<string, string>>>"
    points = packed.select(F.inline(F.from_json("payload", point)))
    tags = F.col("tags")
    return points.select(
        "metric", "timestamp", F.round("value", 6).alias("value"), tags["container"].alias("container"),
        tags["app"].alias("app"), F.coalesce(tags["stageID"], tags["TID"]).alias("tag_value"),
    )


# A line for each container rule, as text around the event's number and value, and the facts it gives (rule, group, name, value).
_RULE_LINES = (
    ("Running task 1.0 in stage 2.0 (TID {n})", ((0, 0, "stage", "2.0"), (0, 1, "task", "1.0"))),
    ("Finished task 1.0 in stage 2.0 (TID {n}). {n} bytes", ((1, 0, "stage", "1.0"), (1, 1, "task", "1.0"), (1, 2, "byte.transferred", "{n}"))),
    ("Executor killed task 3.0 in stage 2.0 (TID {n})", ((2, 0, "task", "1.0"),)),
    ("Block b stored as bytes in memory (estimated size 7.5 KB, free 1 MB)", ((3, 0, "byte.stored", "7680.0"),)),
    ("Task {n} force spilling in-memory map to disk and it will release 2.5 MB memory", ((4, 0, "byte.spill", "2621440.0"),)),
    ("Thread 1 spilling in-memory map of 1.5 KB to disk (1 time so far)", ((5, 0, "byte.spill", "1536.0"),)),
    ("Don't have map outputs for shuffle {n}, fetching them", ((6, 0, "shuffle", "1.0"),)),
    ("Started {n} remote fetches in 5 ms", ((7, 0, "shuffle", "1.0"),)),
    ("Down to the last merge-pass, with 2 segments left of total size: {n}", ((8, 0, "merge", "{n}"),)),
    ("kvstart = 26214396; kvend = 1; length = {n}/6553600", ((9, 0, "spill.key", "{n}"), (9, 1, "spill.value", "6553600"))),
    ("fetcher#3 about to shuffle output of map m decomp: 1 len: {n} to MEMORY", ((10, 0, "fetcher", "{n}"),)),
    ("h:1 freed by fetcher#3 in 12ms", ((11, 0, "fetcher", "1.0"),)),
)
_RULE_FACTS = " UNION ALL ".join(
    f"SELECT event_id AS seq, container_id, ms * 1000 - 7200000000 AS us, {rule} AS rule_id, {group} AS group_id, '{name}' AS name, "
    f"{value.replace('{n}', 'event_id')}::DOUBLE AS value FROM ev WHERE event_id % 13 = {i}"
    for i, (_, facts) in enumerate(_RULE_LINES)
    for rule, group, name, value in facts
)


@query("src6_all_container_rules", _RULE_FACTS)
def all_container_rules(spark, sf_dir):
    """A line for each of the bundled container rules, and one for none of them."""
    n = F.col("event_id")
    texts = F.array(*[F.replace(F.lit(text), F.lit("{n}"), n.cast("string")) for text, _ in _RULE_LINES], F.lit("nothing to see"))
    body = F.get(texts, (n % 13).cast("int"))
    lines = demo.events(spark, sf_dir).select("container_id", n.alias("seq"), F.concat("ts_text", F.lit(" INFO "), body).alias("line"))
    facts = extract.apply_rules(lines, bundled.DEFAULT.container)
    return facts.select("seq", "container_id", _us().alias("us"), "rule_id", "group_id", "name", "value")


@query(
    "str11_latency",
    """SELECT 'test' AS metric, (epoch_us(ts) // 1000) AS timestamp, 1.0 AS value, value::BIGINT AS sent_ms,
      epoch_us(ts) // 1000 - value::BIGINT AS latency_ms FROM routed WHERE route = 'probe'""",
)
def probe_latency(spark, sf_dir):
    probes = demo.routed(spark, sf_dir).where(F.col("route") == "probe")
    return latency(probes, F.col("ts")).select("metric", "timestamp", "value", "sent_ms", "latency_ms")


@query(
    "str2_emitted_counts",
    f"""WITH {_PAIRED},
    grid AS (SELECT *, (start_us + 3599999999) // 3600000000 AS lo,
        (end_us + 3599999999) // 3600000000 - 1 AS last, 1706659200000000 // 3600000000 AS now FROM paired),
    span AS (SELECT *, CASE closed_by WHEN 'finish' THEN greatest(lo, last)
        WHEN 'container_finish' THEN last ELSE now END AS hi FROM grid)
    SELECT type, name, sum(n)::BIGINT AS n FROM (
      SELECT 'period' AS type, 'task' AS name, hi - lo + 1 AS n FROM span WHERE hi >= lo
      UNION ALL SELECT type, name, 1 FROM cf WHERE type = 'instant'
      UNION ALL SELECT 'instant', name, 1 FROM nm UNION ALL SELECT 'instant', name, 1 FROM rm)
    GROUP BY ALL""",
)
def emitted_counts(spark, sf_dir):
    horizon = F.lit("2024-01-31 00:00:00").cast("timestamp")
    facts = stage(demo.facts(spark, sf_dir))
    out = flows.emitted(facts, demo.stored_finishes(spark, sf_dir), demo.HOUR, horizon)
    return out.groupBy("type", "name").agg(F.count(F.lit(1)).alias("n"))




@query(
    "prj2_fact_rejects",
    """SELECT event_id AS seq, container_id, 0 AS rule_id, g AS group_id, (['x', 'one', 'y'])[g + 1] AS name,
      CASE WHEN event_id % 5 = 0 THEN 'time' ELSE 'value' END AS reason
    FROM (SELECT *, unnest([0, 1, 2]) AS g FROM ev)
    WHERE event_id % 5 = 0 OR g = 2 OR (g = 0 AND event_id % 3 = 0)""",
)
def fact_rejects(spark, sf_dir):
    """Groups of matched lines without a readable time or value."""
    e = F.col("event_id")
    stamp = F.when(e % 5 == 0, F.lit("no time")).otherwise(F.col("ts_text"))
    number = F.when(e % 3 == 0, F.lit("none")).otherwise(e.cast("string"))
    lines = demo.events(spark, sf_dir).select(
        "container_id", e.alias("seq"), F.concat(stamp, F.lit(" x="), number).alias("line")
    )
    groups = (demo.Group("x", "instant", "x"), demo.Group("one", "event", "1"), demo.Group("y", "instant", "missing"))
    return extract.rejected_facts(lines, [demo.Rule(r".*x=(?<x>\S+).*", groups)])


@query(
    "win8_null_keys",
    """SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN container_id END AS container_id,
      lag(value) OVER (PARTITION BY CASE WHEN user_id % 7 <> 0 THEN container_id END ORDER BY us, event_id) AS before
    FROM ev""",
)
def null_key_lag(spark, sf_dir):
    """The previous value per container, rows without a container being a series of their own."""
    known = F.when(F.col("user_id") % 7 != 0, F.col("container_id"))
    rows = stage(demo.events(spark, sf_dir).select("event_id", known.alias("container_id"), "ts", "value"))
    out = segments.lag(rows, ["container_id"], segments.micros(), ["ts", "event_id"], {"before": "value"})
    return out.select("event_id", "container_id", "before")
