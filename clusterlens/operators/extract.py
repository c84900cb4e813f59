"""Routing of keyed records and rule-driven extraction of facts from log lines.

Everything here is map-only: no shuffle, and each pattern is a literal that is compiled once per task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.functions import ids, scalars
from clusterlens.functions.states import any_state_code
from clusterlens.sources.rules import Rule, RuleSet

# Fixed patterns and names of record routes.
FINISH_PATTERN = r"\Acontainer.* is finished\.\z"
METRIC_KEY = r"\Acontainer.*-metric\z"
CONTAINER_LOG_KEY = r"\Acontainer.*-log\z"

INSTANT = "instant"
PERIOD = "period"


def route(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Add `route`; the first rule that fits wins."""
    k, v = F.col(key), F.col(value)

    def fits(text: Column, pattern: str, end: str) -> Column:
        """A plain test of both ends spares the regex on records of other routes."""
        return text.startswith("container") & text.endswith(end) & text.rlike(pattern)

    return df.withColumn(
        "route",
        F.when(k.isNull() | v.isNull(), "drop")
        .when(fits(v, FINISH_PATTERN, " is finished."), "container_finish")
        .when(k == "testlog-log", "probe")
        .when(fits(k, METRIC_KEY, "-metric"), "metric")
        .when(fits(k, CONTAINER_LOG_KEY, "-log"), "container_log")
        .when(k == "nodemanager-log", "nm_log")
        .when(k == "resourcemanager-log", "rm_log")
        .otherwise("unrecognized"),
    )


def container_finishes(routed: DataFrame) -> DataFrame:
    """Finish markers: the container named at the start of a `... is finished.` record."""
    return routed.where(F.col("route") == "container_finish").withColumn(
        "container_id", F.substring_index("value", " ", 1)
    )


def split_container_line(df: DataFrame, value: str = "value") -> DataFrame:
    """Split `<container> <line>` at the first blank; null columns where the form does not fit."""
    at = F.instr(F.col(value), " ")
    head = F.expr(f"substring({value}, 1, instr({value}, ' ') - 1)")
    rest = F.trim(F.expr(f"substring({value}, instr({value}, ' '))"))
    good = (at > 1) & head.startswith("container")
    return df.withColumn("container_id", F.when(good, head)).withColumn("line", F.when(good, rest))


def rejects(routed: DataFrame) -> DataFrame:
    """Records no reader takes: unknown keys, and log records that name no container."""
    bad_log = (F.col("route") == "container_log") & F.col("container_id").isNull()
    return (
        split_container_line(routed)
        .where((F.col("route") == "unrecognized") | bad_log)
        .select(*routed.columns)
    )


def matching_lines(df: DataFrame, rules: Sequence[Rule], line: str = "line") -> DataFrame:
    """Keep a line when at least one rule matches it whole."""
    return df.where(reduce(or_, [r.matches(F.col(line)) for r in rules], F.lit(False)))


def qualify(type_: Column, name: Column) -> Column:
    return F.concat(type_, F.lit(":"), name)


def unqualify(key: Column) -> tuple[Column, Column]:
    """Type (null if unqualified) and name of a key; parts after the second are ignored."""
    parts = F.split(key, ":")
    name = F.try_element_at(parts, F.lit(2))
    return (
        F.when(name.isNotNull(), F.try_element_at(parts, F.lit(1))),
        F.coalesce(name, key),
    )


def _id_tags(container: Column) -> Column:
    app = ids.container_to_app(container)
    both = F.create_map(F.lit("container"), container, F.lit("app"), app)
    return F.when(app.isNotNull(), both).otherwise(F.create_map(F.lit("container"), container))


def with_ids(df: DataFrame, container: str = "container_id", tags: str = "tags") -> DataFrame:
    """Put `container` and `app` into the tags of facts that have a container."""
    c = F.col(container)
    rest = F.map_filter(F.col(tags), lambda k, v: ~k.isin("container", "app"))
    has_id = c.isNotNull() & (c != "")
    return df.withColumn(
        tags, F.when(has_id, F.map_concat(rest, _id_tags(c))).otherwise(F.col(tags))
    )


# Stands before each capture in the text one run of a pattern gives; a line that holds it gets one of its own.
SEPARATOR = "\x1f"

# One rule as it is asked of the lines of one role: (role, number in its rule list, rule).
Asked = tuple[str, int, Rule]


def _asked(role: str, rules: Sequence[Rule]) -> list[Asked]:
    return [(role, i, rule) for i, rule in enumerate(rules)]


def _separator(line: Column) -> Column:
    """A text that the line does not hold: it would have to hold its own digest."""
    odd = F.contains(line, F.lit(SEPARATOR))
    return F.when(odd, F.concat(F.lit(SEPARATOR), F.md5(line), F.lit(SEPARATOR))).otherwise(F.lit(SEPARATOR))


def _caught(rule: Rule, line: Column) -> Column:
    """All captures of a rule's facts from one run of its pattern; text without a leading separator is no match."""
    sep = F.col("_sep")
    parts = [x for name in _captures(rule) for x in (sep, F.lit(f"${rule.group_index[name]}"))] or [sep]
    return F.regexp_replace(line, F.lit(rule.full_pattern), F.concat(*parts))


def _match(df: DataFrame, asked: Sequence[Asked], line: str) -> DataFrame:
    """One row per (line, matching rule): `_no`, the place of the rule in `asked`, and `_caught`.

    Most lines match nothing and already fail the substring tests of the filter, which is compiled code. On the others
    a rule's pattern runs once, where its substring occurs, also if several roles share the rule. With several roles, `role`
    says which rules a line is read by.
    """
    roles = {role for role, _, _ in asked}
    text, role_of = F.col(line), F.col("role")
    places: dict[Rule, list[tuple[str, int]]] = {}
    for i, (role, _, rule) in enumerate(asked):
        places.setdefault(rule, []).append((role, i))

    def maybe(rule: Rule) -> Column:
        plain = F.contains(text, F.lit(rule.literal)) if rule.literal else text.isNotNull()
        return role_of.isin(*(role for role, _ in places[rule])) & plain if len(roles) > 1 else plain

    def place(rule: Rule) -> Column:
        (_, last), *others = reversed(places[rule])
        return reduce(lambda rest, at: F.when(role_of == at[0], at[1]).otherwise(rest), others, F.lit(last))

    hits = [F.when(maybe(r), F.struct(place(r).alias("_no"), _caught(r, text).alias("_caught"))) for r in places]
    df = df.where(reduce(or_, [maybe(r) for r in places])).withColumn("_sep", _separator(text))
    found = df.select("*", F.inline(F.array_compact(F.array(*hits))))
    return found.where(F.startswith(F.col("_caught"), F.col("_sep")))


# What a rule group asks for, as data: which captures to use and how. `capture` -1 means none.
TEMPLATE_SCHEMA = """ARRAY<ARRAY<STRUCT<
  group_id INT, type STRING, name STRING, is_finish BOOLEAN,
  literal DOUBLE, capture INT, state_kind STRING, container INT,
  tag ARRAY<STRUCT<name STRING, capture INT, how STRING>>>>>"""

# Fixed names of state facts whose value comes from a state table.
RM_STATE_KINDS = {
    "app.state": "app",
    "app.attempt.state": "app_attempt",
    "rm.container.state": "rm_container",
}


def _captures(rule: Rule) -> list[str]:
    """Named groups of a rule that its facts use."""
    used = {name for g in rule.groups for name in (*g.tags, g.value)}
    return [name for name in rule.group_index if name in used]


def _template(rule: Rule, group_id: int, role: str) -> dict | None:
    """The fact of one group, or None when it can never have a value."""
    group = rule.groups[group_id]
    captures = _captures(rule)
    if any(tag not in captures for tag in group.tags):
        return None
    position = {name: i + 1 for i, name in enumerate(captures)}
    literal = scalars.literal_value(group.value or "")
    capture = -1 if literal is not None else position.get(group.value, -1)
    kind = None
    if role == "nm" and group.name == "state":
        kind = "container"
    elif role == "rm":
        kind = RM_STATE_KINDS.get(group.name)
    if kind is not None:
        literal, capture = None, position["state"] if "state" in group.tags else -1
    if literal is None and capture < 0:
        return None
    names_container = role != "container" and "container" in group.tags
    tags = [(t, position[t], "text") for t in group.tags if t != "container"]
    if role != "container":
        tags = [t for t in tags if t[0] != "state"]
    if role == "rm":
        tags = [t for t in tags if t[0] in ("app", "appAttempt")]
        attempt = [t for t in tags if t[0] == "appAttempt"]
        if attempt:
            number = attempt[0][1]
            tags = [("app", number, "attempt_app"), ("app.attempt", number, "text")]
    if role == "container" or names_container:
        tags = [t for t in tags if t[0] != "app"]
    return {
        "group_id": group_id,
        "type": INSTANT if role == "rm" else group.type,
        "name": group.name,
        "is_finish": group.is_finish,
        "literal": literal,
        "capture": capture,
        "state_kind": kind,
        "container": position["container"] if names_container else -1,
        "tag": [dict(zip(("name", "capture", "how"), t, strict=True)) for t in dict.fromkeys(tags)],
    }


def _undefined(rule: Rule, group_id: int) -> dict:
    """A group whose rule can never give it a value, as a template that only rejects use."""
    group = rule.groups[group_id]
    return {
        "group_id": group_id, "type": group.type, "name": group.name, "is_finish": group.is_finish,
        "literal": None, "capture": -1, "state_kind": None, "container": -1, "tag": [],
    }


def _outcomes(matched: DataFrame, asked: Sequence[Asked], line: str, keep: str) -> DataFrame:
    """Facts of (line, rule) rows, or the groups that give none and why, or both; `keep` is facts, rejects or all.

    Only the captures differ per rule, and they come as one text. The rest of the work is driven by one constant table
    of templates.
    """
    text = F.col(line)
    templates = []
    for role, _, rule in asked:
        found = [_template(rule, i, role) for i in range(len(rule.groups))]
        if keep != "facts":
            found = [t or _undefined(rule, i) for i, t in enumerate(found)]
        templates.append([t for t in found if t is not None])
    captured = F.split("_caught", F.col("_sep"), -1)  # the first part is empty
    table = F.from_json(F.lit(json.dumps(templates)), TEMPLATE_SCHEMA)
    per_group = F.element_at(table, F.col("_no") + 1)
    own = F.col("container_id") if any(role == "container" for role, _, _ in asked) else F.lit(None).cast("string")
    offsets = F.array(*[F.lit(r.date_offset * 1000).cast("bigint") for _, _, r in asked])
    numbers = F.array(*[F.lit(i) for _, i, _ in asked])
    # The time depends on the rule, so the optimizer cannot parse it before the lines are matched; a
    # missing one yields no templates, which spares a filter that would parse it a second time.
    us = F.unix_micros(scalars.parse_log_ts(text)) + F.get(offsets, F.col("_no"))
    wanted = F.when(F.col("_us").isNotNull(), per_group) if keep == "facts" else per_group
    rows = matched.select(
        "seq", own.alias("_own"), "_no", F.get(numbers, F.col("_no")).alias("rule_id"), captured.alias("_c"), us.alias("_us")
    ).select("seq", "_own", "rule_id", "_c", "_us", F.inline(wanted))
    named = F.when(F.col("capture") > 0, F.get("_c", F.col("capture")))
    value = F.coalesce(
        F.col("literal"),
        F.when(
            F.col("state_kind").isNotNull(), any_state_code(F.col("state_kind"), scalars.first_word(named))
        ).otherwise(scalars.parse_with_unit(named)),
    )
    container = F.coalesce(
        "_own",
        F.when(
            F.col("container") > 0,
            F.nullif(scalars.sanitize_tag(F.get("_c", F.col("container"))), F.lit("")),
        ),
    )

    reason = F.when(F.col("_us").isNull(), "time").otherwise(F.when(value.isNull(), "value"))
    if keep == "rejects":
        rows = rows.select("seq", container.alias("container_id"), "rule_id", "group_id", "name", reason.alias("reason"))
        return rows.where(F.col("reason").isNotNull())

    def tag_value(tag: Column) -> Column:
        clean = scalars.sanitize_tag(F.get(F.col("_c"), tag["capture"]))
        return F.when(tag["how"] == "attempt_app", ids.attempt_to_app(clean)).otherwise(clean)

    tags = F.map_from_arrays(F.col("tag.name"), F.transform("tag", tag_value))
    ids_of = F.create_map(F.lit("container"), F.col("container_id"))
    with_app = F.create_map(F.lit("container"), F.col("container_id"), F.lit("app"), F.col("_app"))
    rows = rows.withColumns({"value": value, "container_id": container, "tags": tags, "reason": reason})
    if keep == "facts":
        rows = rows.where(F.col("value").isNotNull())
    return rows.withColumn("_app", ids.container_to_app(F.col("container_id"))).select(
        "container_id",
        F.coalesce("_app", F.col("tags")["app"]).alias("app_id"),
        F.timestamp_micros("_us").alias("ts"),
        "type",
        "name",
        F.when(F.col("container_id").isNull(), F.col("tags"))
        .when(F.col("_app").isNull(), F.map_concat("tags", ids_of))
        .otherwise(F.map_concat("tags", with_app))
        .alias("tags"),
        "value",
        "is_finish",
        "rule_id",
        "group_id",
        "seq",
        *(["reason"] if keep == "all" else []),
    )


def apply_rules(df: DataFrame, rules: Sequence[Rule], line: str = "line") -> DataFrame:
    """Facts of container log lines: every rule that matches gives one fact per group.

    Needs columns `container_id`, `line` and `seq` (arrival order).
    """
    return extract(df, _asked("container", rules), line)


def apply_manager_rules(
    df: DataFrame, rules: Sequence[Rule], role: str, line: str = "line"
) -> DataFrame:
    """Facts of daemon log lines; `role` is `nm` (node manager) or `rm` (resource manager).

    Needs columns `line` and `seq`.
    """
    if role not in ("nm", "rm"):
        raise ValueError(f"unknown daemon role: {role}")
    return extract(df, _asked(role, rules), line)


def extract(df: DataFrame, asked: Sequence[Asked], line: str = "line", keep: str = "facts") -> DataFrame:
    """Facts (or `rejects`, or with `reason` as well `all`) of lines, each read by the rules of its role."""
    return _outcomes(_match(df, asked, line), asked, line, keep)


def role_lines(routed: DataFrame) -> DataFrame:
    """Lines of container and daemon logs (seq, role, container_id, line) from routed records, in one scan."""
    route_of = F.col("route")
    role = F.when(route_of == "container_log", "container").when(route_of == "nm_log", "nm").when(route_of == "rm_log", "rm")
    rows = split_container_line(routed.select("seq", "value", role.alias("role")).where(F.col("role").isNotNull()))
    own = F.col("role") == "container"
    line = F.when(own, F.col("line")).otherwise(F.col("value"))
    return rows.select("seq", "role", F.when(own, F.col("container_id")).alias("container_id"), line.alias("line")).where(
        F.col("line").isNotNull()
    )


def apply_rule_set(lines: DataFrame, rules: RuleSet, keep: str = "facts") -> DataFrame:
    """Facts of `role_lines` of all roles in one pass; with `keep="all"` also the rejects, told by `reason`.

    `reason` is null for a fact. Store the result where both are wanted: the lines are then read once.
    """
    asked = [*_asked("container", rules.container), *_asked("nm", rules.manager), *_asked("rm", rules.manager)]
    return extract(lines, asked, keep=keep)


def rejected_facts(
    df: DataFrame, rules: Sequence[Rule], role: str = "container", line: str = "line"
) -> DataFrame:
    """What matched lines fail to give: (seq, container_id, rule_id, group_id, name, reason).

    The twin of `apply_rules` and `apply_manager_rules`: facts and rejects together are one row per group of each
    matching rule. `reason` is `time` where the line has no readable time, else `value` where the group has no
    value: an unreadable number, an unknown state or a capture its rule does not have.
    """
    return extract(df, _asked(role, rules), line, keep="rejects")
