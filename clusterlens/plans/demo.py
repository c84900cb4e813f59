"""The driver's tables seen as logs and metrics of a cluster.

`events` has one row per event; every event becomes a metric record and one or two log records of the
container its user stands for. Nothing is sampled: each view covers the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.functions import scalars, states
from clusterlens.operators import cells, extract
from clusterlens.plans import flows
from clusterlens.session import configure, stage
from clusterlens.sources import bundled
from clusterlens.sources.rules import Group, Rule

MINUTE = 60_000
HOUR = 3_600_000
RECORDS_PER_EVENT = 4
TASKS = 16
TASK_EVENTS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the container and application of their user and the text form of their time."""
    user = F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(
        "event_id", ts.alias("ts"), "user_id", "event_type", "value"
    )
    # a test table is one row group; log text would be cut by the file system
    rows = rows.repartition(max(TASKS, math.ceil(rows.count() / TASK_EVENTS)), "event_id")
    return (
        rows.withColumn(
            "container_id",
            F.format_string("container_1500000000000_%04d_01_%06d", user % 10, user),
        )
        .withColumn("app_id", F.format_string("application_1500000000000_%04d", user % 10))
        .withColumn("ts_text", F.date_format("ts", scalars.TIMESTAMP_FORMAT))
    )


def _pick(names: list[str], number: Column) -> Column:
    """One of the names and of one unknown name, by number."""
    options = F.array(*[F.lit(n) for n in [*names, "BOGUS"]])
    return F.element_at(options, (F.pmod(number, F.lit(len(names) + 1)) + 1).cast("int"))


def metric_line() -> Column:
    """Metric text of an event: signups lack a field, errors of even users have a broken number, views
    carry extra tags."""
    e = F.col("event_id")
    odd_number = (F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)
    fields = [
        F.col("container_id"),
        F.col("ts_text"),
        F.when(odd_number, "n/a").otherwise(F.col("value").cast("string")),
        (e * 1000).cast("string"),
        (e % 97).cast("string"),
        F.col("user_id").cast("string"),
        (e % 13).cast("string"),
        (e % 7).cast("string"),
        (e % 1000).cast("string"),
    ]
    tail = (
        F.when(F.col("event_type") == "signup", F.lit(""))
        .when(
            F.col("event_type") == "view",
            F.concat(
                F.lit(","),
                F.col("value").cast("string"),
                F.concat(F.lit(",host:h"), (F.col("user_id") % 3).cast("string")),
                F.lit(",junk"),
                F.concat(F.lit(",host:g"), (F.col("user_id") % 2).cast("string")),
                F.lit(",zone:z:ignored"),
            ),
        )
        .otherwise(F.concat(F.lit(","), F.col("value").cast("string")))
    )
    return F.concat(F.concat_ws(",", *fields), tail)


def executor_line() -> Column:
    e, t = F.col("event_id"), F.col("ts_text")
    stage = (F.col("user_id") % 3).cast("string")
    tid = (e % 7).cast("string")
    return (
        F.when(
            F.col("event_type") == "click",
            F.concat(t, F.lit(" INFO Executor: Running task 1.0 in stage "), stage, F.lit(".0 (TID "), tid, F.lit(")")),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(
                t, F.lit(" INFO Executor: Finished task 1.0 in stage "), stage, F.lit(".0 (TID "), tid,
                F.lit("). "), e.cast("string"), F.lit(" bytes result sent to driver"),
            ),
        )
        .when(
            F.col("event_type") == "view",
            F.concat(
                t, F.lit(" INFO MemoryStore: Block b stored as values in memory (estimated size "),
                F.col("value").cast("string"), F.lit(" KB, free 366.3 MB)"),
            ),
        )
    )


def nm_line() -> Column:
    e, c, t = F.col("event_id"), F.col("container_id"), F.col("ts_text")
    return F.when(
        e % 4 == 0, F.concat(t, F.lit(" INFO ContainerManagerImpl: Start request for "), c, F.lit(" by user u1"))
    ).otherwise(
        F.concat(
            t, F.lit(" INFO ContainerImpl: Container "), c, F.lit(" transitioned from X to "),
            _pick(list(states.CONTAINER), e),
        )
    )


def rm_line() -> Column:
    e, t = F.col("event_id"), F.col("ts_text")
    suffix = F.substring("app_id", 13, 100)
    return (
        F.when(
            e % 3 == 0,
            F.concat(t, F.lit(" INFO RMAppImpl: "), F.col("app_id"), F.lit(" State change from X to "), _pick(list(states.APP), e)),
        )
        .when(
            e % 3 == 1,
            F.concat(
                t, F.lit(" INFO RMAppAttemptImpl: appattempt_"), suffix, F.lit("_000001 State change from X to "),
                _pick(list(states.APP_ATTEMPT), e),
            ),
        )
        .otherwise(
            F.concat(
                t, F.lit(" INFO RMContainerImpl: "), F.col("container_id"),
                F.lit(" Container Transitioned from X to "), _pick(list(states.RM_CONTAINER), e),
            )
        )
    )


def log_key() -> Column:
    even = F.col("user_id") % 2 == 0
    return (
        F.when((F.col("event_type") == "error") & even, "nodemanager-log")
        .when(F.col("event_type") == "error", "resourcemanager-log")
        .otherwise(F.concat("container_id", F.lit("-log")))
    )


def log_value() -> Column:
    even = F.col("user_id") % 2 == 0
    return (
        F.when((F.col("event_type") == "error") & even, nm_line())
        .when(F.col("event_type") == "error", rm_line())
        .when(F.col("event_type") == "signup", F.concat("container_id", F.lit(" is finished.")))
        .otherwise(F.concat("container_id", F.lit(" "), executor_line()))
    )


def extra_key() -> Column:
    """A second log record for some events: probes, unknown keys, missing keys, lines of no container."""
    kind = F.col("event_type")
    return (
        F.when(kind == "purchase", "testlog-log")
        .when(kind == "signup", "other")
        .when(kind == "view", F.concat("container_id", F.lit("-log")))
    )


def extra_value() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "purchase", (F.unix_millis("ts") - F.col("event_id") % 50).cast("string"))
        .when(kind == "view", F.concat(F.lit("nobody "), "ts_text"))
        .otherwise(F.lit("x"))
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed records (seq, ts, key, value) of all events."""
    record = [
        F.struct(F.lit(n).alias("n"), key.alias("key"), value.alias("value"))
        for n, (key, value) in enumerate(
            [
                (F.concat("container_id", F.lit("-metric")), metric_line()),
                (log_key(), log_value()),
                (extra_key(), extra_value()),
            ]
        )
    ]
    return (
        events(spark, sf_dir)
        .select("event_id", "ts", F.inline(F.array(*record)))
        .select((F.col("event_id") * RECORDS_PER_EVENT + F.col("n")).alias("seq"), "ts", "key", "value")
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.route(records(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.samples(routed(spark, sf_dir))


def container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = routed(spark, sf_dir).where(F.col("route") == "container_log")
    return extract.split_container_line(lines).where(F.col("line").isNotNull())


def daemon_lines(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    rows = routed(spark, sf_dir).where(F.col("route") == f"{role}_log")
    return rows.select("seq", "ts", F.col("value").alias("line"))


def container_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.apply_rules(container_lines(spark, sf_dir), bundled.DEFAULT.container)


def manager_facts(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return extract.apply_manager_rules(daemon_lines(spark, sf_dir, role), bundled.MANAGER, role)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all roles, from stored records: their text is made here, not read, which is much code for one stage."""
    return flows.facts(stage(routed(spark, sf_dir)), bundled.DEFAULT)


def finishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finish markers, put on the clock of the executor logs."""
    marks = extract.container_finishes(routed(spark, sf_dir))
    return marks.select(
        "container_id", scalars.add_millis(F.col("ts"), bundled.TWO_HOURS_BACK).alias("ts"), "seq"
    )


def sample_cells(spark: SparkSession, sf_dir: str, tick_ms: int = MINUTE) -> DataFrame:
    return cells.sample_cells(samples(spark, sf_dir), tick_ms)


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container facts as a table, for operators that read them more than once."""
    return stage(container_facts(spark, sf_dir))


def stored_finishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(finishes(spark, sf_dir))


def stored_cells(spark: SparkSession, sf_dir: str, tick_ms: int = MINUTE) -> DataFrame:
    return stage(sample_cells(spark, sf_dir, tick_ms))


def task_messages(spark: SparkSession, sf_dir: str, tick_ms: int) -> DataFrame:
    """Running and finished tasks by cell, on the clock of the metrics."""
    rows = stored_facts(spark, sf_dir)
    forward = scalars.add_millis(F.col("ts"), -bundled.TWO_HOURS_BACK)
    return cells.cell_messages(rows.withColumn("ts", forward), tick_ms)


# Rules over prose: what the text tables offer in place of log lines.
PROSE_RULES = (
    Rule(r"(?<word>\w+) (?:the|of) .*", (Group("opening", "instant", "1", ("word",)),)),
    Rule(r".*\s(?<number>[0-9]+)\s?(?<unit>[A-Za-z]*).*", (Group("number", "instant", "number", ("unit",)),)),
    Rule(r".*(?<email>[a-z0-9.]+@[a-z0-9.]+).*", (Group("mail", "instant", "1", ("email",)),)),
)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, stamped so that they can serve as log lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(TASKS, "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select(
        F.concat(F.lit("container_doc_"), F.col("doc_id").cast("string")).alias("container_id"),
        (F.col("doc_id") * 100_000 + F.col("line_no")).alias("seq"),
        "line",
    )


