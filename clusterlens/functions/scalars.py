"""Scalar functions over log text and metric values; all are built-in Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed format: a date and time of day with optional fraction.
TIMESTAMP_TEXT = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,9})?$"
# Fixed pattern: the time at the start of a log line.
LOG_TIME = (
    r"^(?:\d{4}|\d{2})[-/]\d{1,2}[-/]\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}(?:[.,]\d{1,9})?(?=\s|$)"
)
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
# Fixed pattern: a value specification that is a number and not a group name.
LITERAL_VALUE = r"[-+]?\d*(\.\d*)?"
# Fixed factors of size units.
UNIT_FACTORS = {"kb": 1024, "mb": 1024 * 1024, "gb": 1024 * 1024 * 1024}


def strict_timestamp(text: Column) -> Column:
    """Timestamp of a complete date-time text, else null (a bare date or time is no timestamp)."""
    return F.when(text.rlike(TIMESTAMP_TEXT), text.try_cast("timestamp"))


def parse_log_ts(line: Column) -> Column:
    """Timestamp from the first two words of a log line; `/` dates, two-digit years and `,` fractions fit."""
    words = F.translate(F.regexp_extract(line, LOG_TIME, 0), "/,", "-.")
    words = F.regexp_replace(words, r"\s+", " ")
    return F.regexp_replace(words, r"^(\d\d)-", "20$1-").try_cast("timestamp")


def add_millis(ts: Column, millis: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(millis * 1000)) if millis else ts


def parse_with_unit(text: Column) -> Column:
    """Number with an optional size unit: `4.1 KB` -> 4198.4; unknown units count as 1."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, r"(?s)^(.*[0-9])[^0-9]*$", 1).try_cast("double")
    unit = F.lower(F.trim(F.regexp_extract(trimmed, r"(?s)^.*[0-9]([^0-9]*)$", 1)))
    factors = F.create_map(*[F.lit(x) for name, f in UNIT_FACTORS.items() for x in (name, float(f))])
    return number * F.coalesce(F.try_element_at(factors, unit), F.lit(1.0))


def literal_value(spec: str) -> float | None:
    """Number a rule's value text stands for, or None when it names a capture group."""
    return float(spec) if re.fullmatch(LITERAL_VALUE, spec) and re.search(r"\d", spec) else None


def sanitize_tag(text: Column) -> Column:
    return F.regexp_replace(text, r"\s|#", "_")


def first_word(text: Column) -> Column:
    return F.try_element_at(F.split(text, r"\s+", 2), F.lit(1))


def memory_limit(system_kb: Column, container_bytes: Column) -> Column:
    """Effective limit in kB: the smaller of the host's and the container's."""
    return F.least(system_kb, F.floor(container_bytes / 1000))


def is_integral(value: Column) -> Column:
    return value == F.floor(value)


def as_long(value: Column) -> Column:
    return value.try_cast("bigint")


def as_double(value: Column) -> Column:
    return value.try_cast("double")


def to_megabytes(value: Column) -> Column:
    return value / 1000000


def format_millis(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), TIMESTAMP_FORMAT)


def plain_number(value: Column) -> Column:
    """Text of a double without an exponent, as counters are written: 13948000.0, not 1.3948E7.

    Numbers that 18 decimals or 20 digits before the point do not hold exactly keep the exponent, so the text always reads back as
    the same number.
    """
    size = F.abs(value)
    exact = value.try_cast("decimal(38,18)")
    digits = F.regexp_replace(F.regexp_replace(exact.cast("string"), "0+$", ""), r"\.$", ".0")
    # an engine writes the smallest of these as 0E-18
    with_exponent = (size >= 1e7) | ((size < 1e-3) & (size > 1e-17))
    return F.when(with_exponent & (exact.cast("double") == value), digits).otherwise(value.cast("string"))
