"""Extraction rules: a regex with named groups and the facts it yields."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = """
regex STRING, dateOffset STRING,
group ARRAY<STRUCT<name STRING, type STRING, tag ARRAY<STRING>,
                   tags STRUCT<tag ARRAY<STRING>>, isFinish STRING, value STRING>>
"""


@dataclass(frozen=True)
class Group:
    """One fact a matching line yields."""

    name: str
    type: str
    value: str | None
    tags: tuple[str, ...] = ()
    is_finish: bool = False


@dataclass(frozen=True)
class Rule:
    """A line pattern (Java regex, must match the whole line) and its facts."""

    regex: str
    groups: tuple[Group, ...]
    date_offset: int = 0
    group_index: dict[str, int] = field(init=False, compare=False, repr=False)
    literal: str | None = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        index, literal = scan_pattern(self.regex)
        object.__setattr__(self, "group_index", index)
        object.__setattr__(self, "literal", literal)

    @property
    def full_pattern(self) -> str:
        return rf"\A(?:{self.regex})\z"

    def matches(self, line: Column) -> Column:
        """Whole-line match; a plain substring test spares the regex on most other lines."""
        hit = line.rlike(self.full_pattern)
        return F.contains(line, F.lit(self.literal)) & hit if self.literal else hit

    def capture(self, line: Column, name: str) -> Column:
        """Text of a named group, null when the pattern has no such group."""
        if name not in self.group_index:
            return F.lit(None).cast("string")
        return F.regexp_extract(line, self.full_pattern, self.group_index[name])


def scan_pattern(regex: str) -> tuple[dict[str, int], str | None]:
    """Named-group positions and the longest text that every match must contain."""
    names: dict[str, int] = {}
    runs, run = [], ""
    count = depth = pos = 0
    in_class = alternation = False
    while pos < len(regex):
        char = regex[pos]
        if char == "\\":
            escaped = regex[pos + 1 : pos + 2]
            plain = not in_class and depth == 0 and not escaped.isalnum()
            char, pos = (escaped if plain else ""), pos + 1
        elif in_class:
            in_class = char != "]"
            char = ""
        elif char == "[":
            in_class, char = True, ""
            if regex[pos + 1 : pos + 2] == "]":
                pos += 1
        elif char == "(":
            rest = regex[pos + 1 :]
            named = rest.startswith("?<") and rest[2:3] not in ("=", "!")
            if named or not rest.startswith("?"):
                count += 1
            if named:
                names[rest[2 : rest.index(">")]] = count
            depth, char = depth + 1, ""
        elif char == ")":
            depth, char = depth - 1, ""
        elif char == "|":
            alternation, char = alternation or depth == 0, ""
        elif char in ".^$*+?{}":
            if char == "{":
                pos = regex.index("}", pos)
            char = ""
        if char and depth == 0:
            follower = regex[pos + 1 : pos + 2]
            if follower in ("*", "?", "{"):
                runs, run = [*runs, run], ""
            elif follower == "+":
                runs, run = [*runs, run + char], ""
            else:
                run += char
        else:
            runs, run = [*runs, run], ""
        pos += 1
    longest = max([*runs, run], key=len)
    usable = longest and not alternation and "(?i" not in regex and "(?x" not in regex
    return names, longest if usable and "\\Q" not in regex else None


@dataclass(frozen=True)
class RuleSet:
    """Rules for container logs and rules for daemon logs."""

    container: tuple[Rule, ...] = ()
    manager: tuple[Rule, ...] = ()

    def with_container(self, rules: Iterable[Rule]) -> RuleSet:
        return RuleSet((*self.container, *rules), self.manager)

    def with_manager(self, rules: Iterable[Rule]) -> RuleSet:
        return RuleSet(self.container, (*self.manager, *rules))


def _blank_to_none(text: str | None) -> str | None:
    return text if text and text.strip() else None


def _group(row) -> Group | None:
    name = _blank_to_none(row["name"])
    if name is None:
        return None
    value = _blank_to_none(row["value"])
    if value is None and not name.endswith("state"):
        raise ValueError(f"rule group '{name}' has no <value>")
    nested = row["tags"]["tag"] if row["tags"] is not None else None
    return Group(
        name=name,
        type=_blank_to_none(row["type"]),
        value=value,
        tags=tuple([*(row["tag"] or []), *(nested or [])]),
        is_finish=(row["isFinish"] or "").strip().lower() == "true",
    )


def load_rules(spark: SparkSession, paths: str | list[str]) -> list[Rule]:
    """Rules of XML files, in file order. Rules are a small plan-time constant, hence on the driver.

    A rule without a regex is dropped, a group without a name is skipped.
    """
    rules = []
    for path in [paths] if isinstance(paths, str) else paths:
        rows = (
            spark.read.format("xml")
            .option("rowTag", "rule")
            .option("mode", "FAILFAST")
            .schema(RULE_SCHEMA)
            .load(path)
            .coalesce(1)
        )
        for row in rows.toLocalIterator():
            regex = _blank_to_none(row["regex"])
            if regex is None:
                continue
            groups = tuple(g for g in map(_group, row["group"] or []) if g is not None)
            rules.append(Rule(regex, groups, int(row["dateOffset"] or 0)))
    return rules
