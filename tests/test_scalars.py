from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clusterlens.functions import ids, scalars, states


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t STRING").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("17/07/25 23:57:16 INFO x", datetime(2017, 7, 25, 23, 57, 16)),
        ("2017-07-25 23:57:16,352 more", datetime(2017, 7, 25, 23, 57, 16, 352000)),
        ("2017-07-25   23:57:16.5", datetime(2017, 7, 25, 23, 57, 16, 500000)),
        ("bad line", None),
        ("2017-07-25", None),
        ("2017-07-25 23:57:16: x", None),
        (" 2017-07-25 23:57:16 x", None),
    ],
)
def test_log_time(spark, line, expected):
    assert one(spark, line, scalars.parse_log_ts) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1665", 1665.0),
        ("4.1 KB", 4198.4),
        (" 2 mb ", 2097152.0),
        ("1 GB", 1073741824.0),
        ("305.0 B", 305.0),
        ("KB", None),
        ("1.2.3 KB", None),
    ],
)
def test_units(spark, text, expected):
    assert one(spark, text, scalars.parse_with_unit) == expected


@pytest.mark.parametrize(
    ("spec", "expected"), [("1", 1.0), ("-2.5", -2.5), ("+3.", 3.0), (".", None), ("", None), ("byte", None)]
)
def test_literal_value(spec, expected):
    assert scalars.literal_value(spec) == expected


def test_sanitize_and_first_word(spark):
    assert one(spark, "fetcher#3 a", scalars.sanitize_tag) == "fetcher_3_a"
    assert one(spark, "RUNNING on event", scalars.first_word) == "RUNNING"


@pytest.mark.parametrize(
    ("container", "app"),
    [
        ("container_1502222838299_0001_01_000002", "application_1502222838299_0001"),
        ("container_e17_1502222838299_0001_01_000002", "application_1502222838299_0001"),
        ("01_000001", None),
    ],
)
def test_container_to_app(spark, container, app):
    assert one(spark, container, ids.container_to_app) == app


def test_short_ids(spark):
    assert one(spark, "container_1502222838299_0001_01_000002", ids.short_container) == "01_000002"
    assert one(spark, "application_1502222838299_0001", ids.short_app) == "1502222838299_0001"
    assert one(spark, "appattempt_15_0001_000002", ids.attempt_to_app) == "application_15_0001"
    assert one(spark, "appattempt_15_0001_000002", ids.short_attempt) == "000002"


@pytest.mark.parametrize(
    ("kind", "state", "code"),
    [("container", "RUNNING", 4.0), ("app", "FINISHED", 8.0), ("app_attempt", "FINISHED", 9.0), ("app", "X", None)],
)
def test_state_codes(spark, kind, state, code):
    assert one(spark, state, lambda c: states.state_code(kind, c)) == code
    assert one(spark, state, lambda c: states.any_state_code(F.lit(kind), c)) == code


def test_memory_limit_and_kind(spark):
    df = spark.createDataFrame([(10, 5999, 2.0, 2.5)], "s BIGINT, c BIGINT, a DOUBLE, b DOUBLE")
    row = df.select(
        scalars.memory_limit(F.col("s"), F.col("c")),
        scalars.is_integral(F.col("a")),
        scalars.is_integral(F.col("b")),
    ).first()
    assert tuple(row) == (5, True, False)


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (13948000.0, "13948000.0"), (123456789.25, "123456789.25"), (-2.5e9, "-2500000000.0"), (9999999.5, "9999999.5"),
        (0.00025, "0.00025"), (0.0, "0.0"), (-0.0, "-0.0"), (77.97, "77.97"), (1e300, "1.0E300"), (1e-30, "1.0E-30"),
        (float("nan"), "NaN"), (float("inf"), "Infinity"), (None, None),
    ],
)
def test_plain_number(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v DOUBLE")
    assert df.select(scalars.plain_number(F.col("v"))).first()[0] == expected
