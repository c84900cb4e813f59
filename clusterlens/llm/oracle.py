"""DuckDB SQL of the queries that SQL can express, written against the definitions rather than the operators."""

from __future__ import annotations

from clusterlens.llm import urls

WORDS = r"[^\x20\x09-\x0D]+"

# The mix by sorting: keys in order, running sizes, and the prefix of documents nearest to the rest.
OP1 = rf"""
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources),
filled AS (
  SELECT *, row_number() OVER o AS place,
         (budget - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed
  WINDOW o AS (ORDER BY most / weight, source ASC NULLS LAST),
         b AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fair AS (SELECT min_by(level, place) AS level FROM filled WHERE most / weight > level),
goal AS (
  SELECT f.source, source_size, CASE WHEN g.level IS NULL THEN most ELSE least(most, weight * g.level) END AS target
  FROM filled f, fair g),
rest AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM goal),
units AS (
  SELECT source, key, sum(size) AS n FROM keyed GROUP BY source, key),
run AS (
  SELECT u.source, u.key, sum(n) OVER (PARTITION BY u.source ORDER BY u.key) AS upto, n,
         r.target - r.passes * r.source_size AS rest
  FROM units u JOIN rest r ON u.source IS NOT DISTINCT FROM r.source),
cut AS (
  SELECT source, max(key) AS last_key FROM run
  WHERE upto <= rest OR (upto - n <= rest AND upto - rest < rest - (upto - n)) GROUP BY source)
SELECT k.doc_id, k.size, r.source_size, r.target,
       (k.size * (r.passes + CASE WHEN k.key <= c.last_key THEN 1 ELSE 0 END))::BIGINT AS taken
FROM keyed k JOIN rest r ON k.source IS NOT DISTINCT FROM r.source
LEFT JOIN cut c ON k.source IS NOT DISTINCT FROM c.source
"""


def _terms(terms: tuple) -> str:
    tests = [f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END" for t in terms]
    return " + ".join(tests)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH parts AS (
  SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS low,
         {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    {_terms(urls.STRICT)} AS hard, {_terms(urls.SOFT)} AS weak
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN hard >= 1 OR weak >= {urls.LEAST_SOFT} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""

OP9 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
long AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, list_aggregate(w[i : i + 19], 'string_agg', ' ') AS k FROM long),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT a.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(
         [x.v FOR x IN list_zip(w, range(1, len(w) + 1)).list_transform(lambda z: {{'v': z[1], 'p': z[2]}})
          IF ps IS NULL OR NOT list_contains(ps, x.p)], ' '), '')) AS kept_sha256
FROM words a LEFT JOIN lost b ON a.doc_id IS NOT DISTINCT FROM b.doc_id
"""

OP12 = rf"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM worded GROUP BY text),
failed AS (
  SELECT doc_id, part,
         {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
           'C': 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * len(d.text),
           'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(least < doc_id, false)}} AS f
  FROM worded d JOIN firsts USING (text)),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
judged AS (
  SELECT part, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n,
         count(*) FILTER (doc_id IN (FROM good)) AS good, count(*) FILTER (doc_id IN (FROM toxic)) AS toxic
  FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
laid AS (
  SELECT j.*, filter_order, step, filter_order[step] AS x,
         concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS bad
  FROM judged j, steps),
told AS (
  SELECT *, contains(bad, x) AS fails,
         step > 1 AND len(list_intersect(string_split(bad, ''), string_split(filter_order[1 : step - 1], ''))) > 0 AS gone
  FROM laid),
summed AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (bad = x), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM told GROUP BY ALL)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM summed
"""


def _edit(state: str, letter: str, cost: str, piece: str | None = None) -> str:
    """A way (cost, audit, text so far) one edit further; null where there is none."""
    text = f"{state}.t" if piece is None else f"CASE WHEN {state}.t IS NULL THEN {piece} ELSE {state}.t || chr(10) || {piece} END"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"


def _row_edits(state: str, initial: str, name: str) -> list[str]:
    keep, free = _edit(state, "K", "more", "role || ':' || text"), "fault NOT IN ('b', 'd')"
    out = [f"CASE WHEN {free} AND role[1:1] = '{initial}' THEN {keep} END"]
    return out + ([f"CASE WHEN {free} THEN {_edit(state, 'R', '2 + more', f"'{name}:' || text")} END"] if name else [])


_OPEN = "list_min([su, " + ", ".join(_edit(s, "I", "2", "'user:'") for s in ("s0", "ss", "sa")) + "])"  # after user, rows inserted
_SHUT = f"list_min([sa, {_edit('u1', 'I', '2', "'assistant:'")}])"
_WAY = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
# The repair by walking forward, one row of every conversation at a time, with the least way to each of the four states.
OP11 = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT),
        lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295) % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || ':' || text || ':' || len(role)), copy) AS i
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN regexp_extract(text, '(?s)([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
    coalesce(lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] NOT IN ('su', 'ua', 'au'), false) AS apart
  FROM placed),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': NULL}}::{_WAY} AS s0, NULL::{_WAY} AS ss, NULL::{_WAY} AS su, NULL::{_WAY} AS sa
  FROM drawn
  UNION ALL
  SELECT conv_id, i, {_edit("s0", "D", "3")}, list_min([{", ".join([_edit("ss", "D", "3"), *_row_edits("s0", "s", "")])}]),
    list_min([{", ".join([_edit("u1", "D", "3"), *(e for s in ("s0", "ss", "a1") for e in _row_edits(s, "u", "user"))])}]),
    list_min([{", ".join([_edit("a1", "D", "3"), *_row_edits("u1", "a", "assistant")])}])
  FROM (SELECT *, {_SHUT} AS a1 FROM (SELECT w.conv_id, f.i, role, text, fault, CASE fault WHEN 't' THEN 1 ELSE 0 END AS more, s0, ss, su, sa, {_OPEN} AS u1
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
ended AS (
  SELECT conv_id, list_min([s0, {_SHUT}]) AS way
  FROM (SELECT *, {_OPEN} AS u1 FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (apart) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, way.c AS cost, way.a AS audit,
  sha256(coalesce(way.t, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES = {
    "op1_mixing": OP1,
    "op2_url_filter": OP2,
    "op6_exact_dedup": OP6,
    "op9_repeats": OP9,
    "op11_conversations": OP11,
    "op12_filter_audit": OP12,
}
