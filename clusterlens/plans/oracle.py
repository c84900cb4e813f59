"""SQL form of the demo views, for checking the registered queries in a second engine."""

from __future__ import annotations

import re

from clusterlens.functions import states


def _names(table) -> str:
    """State names in order of their codes, as a SQL list without brackets."""
    return ",".join(f"'{name}'" for name in table)


CONTAINER_STATES = _names(states.CONTAINER)
APP_STATES = _names(states.APP)
ATTEMPT_STATES = _names(states.APP_ATTEMPT)
RM_CONTAINER_STATES = _names(states.RM_CONTAINER)


def state_code(names: str, column: str) -> str:
    return f"nullif(coalesce(list_position([{names}], {column}), 0), 0)::DOUBLE"


# Fixed patterns, those of the bundled rules with named groups in this engine's spelling.
RUNNING = r".*Running task.* in stage (?P<stageID>[0-9]+\.[0-9]).*TID (?P<TID>[0-9]+).*"
FINISHED = r".*Finished task.*in (?P<stageID>stage [0-9]+\.[0-9]).*TID (?P<TID>[0-9]+).*\s(?P<byte>[0-9]+).*"
STORED = r".*stored as (?:values|bytes) in memory.*estimated size (?P<byte>[0-9]+\.[0-9]+.*),.*"
CONTAINER = "container_[0-9]+_[0-9]+_[0-9]+_[0-9]+"
UNIT = """(CASE lower(trim(regexp_extract(trim({0}), '([^0-9]*)$', 1)))
   WHEN 'kb' THEN 1024.0 WHEN 'mb' THEN 1048576.0 WHEN 'gb' THEN 1073741824.0 ELSE 1.0 END)::DOUBLE
   * try_cast(regexp_extract(trim({0}), '(?s)^(.*[0-9])[^0-9]*$', 1) AS DOUBLE)"""

VIEWS = {
    "ev": """
SELECT event_id, ts, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, user_id, event_type, value,
  printf('container_1500000000000_%04d_01_%06d', user_id % 10, user_id) AS container_id,
  printf('application_1500000000000_%04d', user_id % 10) AS app_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts_text
FROM events""",
    "rec": f"""
SELECT event_id * 4 AS seq, ts, container_id || '-metric' AS key,
  concat_ws(',', container_id, ts_text,
    CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'n/a' ELSE value::VARCHAR END,
    event_id * 1000, event_id % 97, user_id, event_id % 13, event_id % 7, event_id % 1000)
  || CASE event_type WHEN 'signup' THEN ''
     WHEN 'view' THEN ',' || value::VARCHAR || ',host:h' || (user_id % 3) || ',junk,host:g'
       || (user_id % 2) || ',zone:z:ignored'
     ELSE ',' || value::VARCHAR END AS value
FROM ev
UNION ALL
SELECT event_id * 4 + 1, ts,
  CASE WHEN event_type <> 'error' THEN container_id || '-log'
       WHEN user_id % 2 = 0 THEN 'nodemanager-log' ELSE 'resourcemanager-log' END,
  CASE event_type
    WHEN 'click' THEN container_id || ' ' || ts_text || ' INFO Executor: Running task 1.0 in stage '
      || (user_id % 3) || '.0 (TID ' || (event_id % 7) || ')'
    WHEN 'purchase' THEN container_id || ' ' || ts_text || ' INFO Executor: Finished task 1.0 in stage '
      || (user_id % 3) || '.0 (TID ' || (event_id % 7) || '). ' || event_id || ' bytes result sent to driver'
    WHEN 'view' THEN container_id || ' ' || ts_text
      || ' INFO MemoryStore: Block b stored as values in memory (estimated size ' || value::VARCHAR
      || ' KB, free 366.3 MB)'
    WHEN 'signup' THEN container_id || ' is finished.'
    ELSE CASE
      WHEN user_id % 2 = 0 AND event_id % 4 = 0 THEN ts_text
        || ' INFO ContainerManagerImpl: Start request for ' || container_id || ' by user u1'
      WHEN user_id % 2 = 0 THEN ts_text || ' INFO ContainerImpl: Container ' || container_id
        || ' transitioned from X to ' || ([{CONTAINER_STATES},'BOGUS'])[event_id % 11 + 1]
      WHEN event_id % 3 = 0 THEN ts_text || ' INFO RMAppImpl: ' || app_id || ' State change from X to '
        || ([{APP_STATES},'BOGUS'])[event_id % 12 + 1]
      WHEN event_id % 3 = 1 THEN ts_text || ' INFO RMAppAttemptImpl: appattempt_' || substr(app_id, 13)
        || '_000001 State change from X to ' || ([{ATTEMPT_STATES},'BOGUS'])[event_id % 14 + 1]
      ELSE ts_text || ' INFO RMContainerImpl: ' || container_id || ' Container Transitioned from X to '
        || ([{RM_CONTAINER_STATES},'BOGUS'])[event_id % 10 + 1] END
  END
FROM ev
UNION ALL
SELECT event_id * 4 + 2, ts,
  CASE event_type WHEN 'purchase' THEN 'testlog-log' WHEN 'signup' THEN 'other'
    WHEN 'view' THEN container_id || '-log' END,
  CASE event_type WHEN 'purchase' THEN (ms - event_id % 50)::VARCHAR
    WHEN 'view' THEN 'nobody ' || ts_text ELSE 'x' END
FROM ev""",
    "routed": r"""
SELECT *, CASE WHEN key IS NULL OR value IS NULL THEN 'drop'
  WHEN regexp_full_match(value, 'container.* is finished\.') THEN 'container_finish'
  WHEN key = 'testlog-log' THEN 'probe'
  WHEN regexp_full_match(key, 'container.*-metric') THEN 'metric'
  WHEN regexp_full_match(key, 'container.*-log') THEN 'container_log'
  WHEN key = 'nodemanager-log' THEN 'nm_log'
  WHEN key = 'resourcemanager-log' THEN 'rm_log' ELSE 'unrecognized' END AS route
FROM rec""",
    "fields": "SELECT seq, key, value, string_split(value, ',') AS f FROM routed WHERE route = 'metric'",
    "smp": """
SELECT seq, f[1] AS container_id, 'application_' || string_split(f[1], '_')[2] || '_'
    || string_split(f[1], '_')[3] AS app_id,
  epoch_us(f[2]::TIMESTAMP) // 1000 AS ms, f[3]::DOUBLE AS cpu, f[4]::DOUBLE AS memory,
  f[5]::DOUBLE AS disk_service_byte, f[6]::DOUBLE AS disk_service_time, f[7]::DOUBLE AS disk_wait_time,
  f[8]::DOUBLE AS disk_io_time, f[9]::DOUBLE + f[10]::DOUBLE AS net_rate, f
FROM fields WHERE len(f) >= 10 AND try_cast(f[3] AS DOUBLE) IS NOT NULL""",
    "lines": """
SELECT seq, substr(value, 1, strpos(value, ' ') - 1) AS container_id,
  trim(substr(value, strpos(value, ' '))) AS line
FROM routed WHERE route = 'container_log' AND strpos(value, ' ') > 1 AND starts_with(value, 'container')""",
    "stamped": """
SELECT *, epoch_us(substr(line, 1, 23)::TIMESTAMP) - 7200000000 AS us,
  'application_' || string_split(container_id, '_')[2] || '_' || string_split(container_id, '_')[3] AS app_id
FROM lines""",
    "cf": f"""
SELECT container_id, app_id, us, 'instant' AS type, 'stage' AS name,
  'stageID' AS tag, regexp_extract(line, '{RUNNING}', 1) AS tag_value,
  regexp_extract(line, '{RUNNING}', 1)::DOUBLE AS value, false AS is_finish,
  0 AS rule_id, 0 AS group_id, seq FROM stamped WHERE regexp_full_match(line, '{RUNNING}')
UNION ALL
SELECT container_id, app_id, us, 'period', 'task', 'TID', regexp_extract(line, '{RUNNING}', 2), 1.0, false,
  0, 1, seq FROM stamped WHERE regexp_full_match(line, '{RUNNING}')
UNION ALL
SELECT container_id, app_id, us, 'instant', 'stage', 'stageID',
  regexp_replace(regexp_extract(line, '{FINISHED}', 1), '\\s|#', '_', 'g'), 1.0, false,
  1, 0, seq FROM stamped WHERE regexp_full_match(line, '{FINISHED}')
UNION ALL
SELECT container_id, app_id, us, 'period', 'task', 'TID', regexp_extract(line, '{FINISHED}', 2), 1.0, true,
  1, 1, seq FROM stamped WHERE regexp_full_match(line, '{FINISHED}')
UNION ALL
SELECT container_id, app_id, us, 'instant', 'byte.transferred', NULL, NULL,
  regexp_extract(line, '{FINISHED}', 3)::DOUBLE, true,
  1, 2, seq FROM stamped WHERE regexp_full_match(line, '{FINISHED}')
UNION ALL
SELECT container_id, app_id, us, 'instant', 'byte.stored', NULL, NULL,
  {UNIT.format(f"regexp_extract(line, '{STORED}', 1)")}, true,
  3, 0, seq FROM stamped WHERE regexp_full_match(line, '{STORED}')""",
    "nm": f"""
SELECT c AS container_id, epoch_us(substr(value, 1, 23)::TIMESTAMP) AS us, 'state' AS name,
  {state_code(CONTAINER_STATES, "state")} AS value, seq
FROM (SELECT *, regexp_extract(value, '.*Container ({CONTAINER}).*transitioned.*to (.*)', 1) AS c,
        regexp_extract(value, '.*Container ({CONTAINER}).*transitioned.*to (.*)', 2) AS state
      FROM routed WHERE route = 'nm_log')
WHERE c <> '' AND {state_code(CONTAINER_STATES, "state")} IS NOT NULL""",
    "rm": f"""
SELECT * FROM (
  SELECT 'app.state' AS name, a AS app_id, NULL AS attempt, NULL AS container_id,
    epoch_us(substr(value, 1, 23)::TIMESTAMP) AS us, {state_code(APP_STATES, "state")} AS value, seq
  FROM (SELECT *, regexp_extract(value, '.*(application_[0-9]+_[0-9]+) State change from.*to (.*)', 1) AS a,
          regexp_extract(value, '.*(application_[0-9]+_[0-9]+) State change from.*to (.*)', 2) AS state
        FROM routed WHERE route = 'rm_log') WHERE a <> ''
  UNION ALL
  SELECT 'app.attempt.state', 'application_' || string_split(a, '_')[2] || '_' || string_split(a, '_')[3],
    a, NULL, epoch_us(substr(value, 1, 23)::TIMESTAMP), {state_code(ATTEMPT_STATES, "state")}, seq
  FROM (SELECT *, regexp_extract(value, '.*(appattempt_[0-9]+_[0-9]+_[0-9]+).*State change from.*to (.*)', 1) AS a,
          regexp_extract(value, '.*(appattempt_[0-9]+_[0-9]+_[0-9]+).*State change from.*to (.*)', 2) AS state
        FROM routed WHERE route = 'rm_log') WHERE a <> ''
  UNION ALL
  SELECT 'rm.container.state', 'application_' || string_split(c, '_')[2] || '_' || string_split(c, '_')[3],
    NULL, c, epoch_us(substr(value, 1, 23)::TIMESTAMP), {state_code(RM_CONTAINER_STATES, "state")}, seq
  FROM (SELECT *, regexp_extract(value, '.*({CONTAINER}) Container Transitioned.*to (.*)', 1) AS c,
          regexp_extract(value, '.*({CONTAINER}) Container Transitioned.*to (.*)', 2) AS state
        FROM routed WHERE route = 'rm_log') WHERE c <> '')
WHERE value IS NOT NULL""",
    "fin": """
SELECT string_split(value, ' ')[1] AS container_id, epoch_us(ts) - 7200000000 AS us, seq
FROM routed WHERE route = 'container_finish'""",
    "mcell": """
SELECT ms - ms % 60000 AS tick, container_id, max_by(app_id, seq) AS app_id, max_by(cpu, seq) AS cpu,
  max_by(memory, seq) AS memory, max_by(disk_service_byte, seq) AS disk_service_byte,
  max_by(disk_service_time, seq) AS disk_service_time, max_by(disk_wait_time, seq) AS disk_wait_time,
  max_by(disk_io_time, seq) AS disk_io_time, max_by(net_rate, seq) AS net_rate
FROM smp GROUP BY ALL""",
    "tick_no": "SELECT tick, tick // 60000 AS t FROM (SELECT DISTINCT tick FROM mcell)",
    "isle": "SELECT tick, t, t - row_number() OVER (ORDER BY t) AS g FROM tick_no",
    "pos": """
SELECT tick, t, g, row_number() OVER (PARTITION BY g ORDER BY t) - 1 AS p,
  count(*) OVER (PARTITION BY g) AS n, min(t) OVER (PARTITION BY g) AS t0 FROM isle""",
    "win": """
SELECT tick, (t0 + k * 2) * 60000 AS window_start, least(3, n - k * 2) AS n_ticks
FROM (SELECT *, unnest(range(greatest(0, (p - 2) // 2), p // 2 + 1)) AS k
      FROM pos)
WHERE p >= k * 2 AND p < k * 2 + 3""",
    "htick": """
SELECT (us + 7200000000) // 1000 - ((us + 7200000000) // 1000) % 3600000 AS tick, container_id, value, seq
FROM cf WHERE name = 'task'""",
    "hcell": """
SELECT ms - ms % 3600000 AS tick, container_id, max_by(memory, seq) AS memory FROM smp GROUP BY ALL""",
}


def with_views(sql: str) -> str:
    """A query on top of the views it names, directly or through another view."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    views = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    if not views:
        return sql
    own = sql.lstrip()
    if not own.startswith("WITH "):
        return f"WITH {views}\n{own}"
    start = "WITH RECURSIVE " if own.startswith("WITH RECURSIVE ") else "WITH "
    return f"{start}{views},\n{own[len(start):]}"
