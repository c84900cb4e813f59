"""Queries on the scalar functions, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterlens.functions import ids, scalars
from clusterlens.plans import demo
from clusterlens.plans.catalog import query
from clusterlens.plans.oracle import UNIT

_TS = r"""(CASE WHEN regexp_full_match({0}, '\d{{4}}-\d{{1,2}}-\d{{1,2}} \d{{1,2}}:\d{{1,2}}:\d{{1,2}}(\.\d{{1,9}})?')
  THEN epoch_us(try_cast({0} AS TIMESTAMP)) END)"""


@query(
    "fun1_log_ts",
    f"""WITH w AS (SELECT event_id, ts_text, replace(substr(ts_text, 3, 21), '-', '/') AS short,
        replace(ts_text, '.', ',') AS comma FROM ev)
    SELECT event_id, {_TS.format("ts_text")} AS plain, {_TS.format("'20' || replace(short, '/', '-')")} AS short,
      {_TS.format("replace(comma, ',', '.')")} AS comma, NULL::BIGINT AS bad FROM w""",
)
def log_ts(spark, sf_dir):
    """Time stamps in long, short-year and comma form, and one without a time."""
    t = F.col("ts_text")
    forms = {
        "plain": F.concat(t, F.lit(" INFO x")),
        "short": F.concat(F.replace(F.substring(t, 3, 21), F.lit("-"), F.lit("/")), F.lit(" INFO x")),
        "comma": F.concat(F.replace(t, F.lit("."), F.lit(",")), F.lit(" INFO x")),
        "bad": F.substring(t, 1, 10),
    }
    return demo.events(spark, sf_dir).select(
        "event_id", *[F.unix_micros(scalars.parse_log_ts(line)).alias(n) for n, line in forms.items()]
    )


@query("fun2_offset", "SELECT event_id, us - 7200000000 AS us FROM ev")
def offset(spark, sf_dir):
    moved = scalars.add_millis(F.col("ts"), -7_200_000)
    return demo.events(spark, sf_dir).select("event_id", F.unix_micros(moved).alias("us"))


_UNIT_TEXT = """(value::VARCHAR || (['', ' KB', 'mb', ' GB', ' B', ' kb '])[event_id % 6 + 1])"""


@query(
    "fun3_units",
    f"SELECT event_id, round({UNIT.format(_UNIT_TEXT)}, 2) AS size FROM events",
)
def units(spark, sf_dir):
    names = F.array(*[F.lit(u) for u in ("", " KB", "mb", " GB", " B", " kb ")])
    unit = F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))
    text = F.concat(F.col("value").cast("string"), unit)
    return demo.events(spark, sf_dir).select(
        "event_id", F.round(scalars.parse_with_unit(text), 2).alias("size")
    )


@query(
    "fun6_sanitized_documents",
    r"""SELECT doc_id, md5(regexp_replace(text, '\s|#', '_', 'g')) AS clean FROM documents""",
)
def sanitized_documents(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(scalars.sanitize_tag(F.col("text"))).alias("clean"))


@query(
    "fun7_first_words",
    r"SELECT conv_id, turn, regexp_extract(text, '^(\S*)', 1) AS word FROM conversations",
)
def first_words(spark, sf_dir):
    talks = demo.table(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", scalars.first_word(F.col("text")).alias("word"))


@query(
    "fun8_container_ids",
    """SELECT event_id, app_id AS app, app_id AS app_with_epoch, NULL::VARCHAR AS of_short,
      substr(app_id, 13) AS short_app, substr(container_id, 30) AS short_container FROM ev""",
)
def container_ids(spark, sf_dir):
    c = F.col("container_id")
    with_epoch = F.replace(c, F.lit("container_"), F.lit("container_e17_"))
    return demo.events(spark, sf_dir).select(
        "event_id",
        ids.container_to_app(c).alias("app"),
        ids.container_to_app(with_epoch).alias("app_with_epoch"),
        ids.container_to_app(ids.short_container(c)).alias("of_short"),
        ids.container_to_short_app(c).alias("short_app"),
        ids.short_container(c).alias("short_container"),
    )


@query(
    "fun9_attempt_ids",
    """SELECT event_id, app_id AS app, substr(app_id, 13) AS short_app, '000002' AS short_attempt,
      substr(app_id, 13) AS short_of_app FROM ev""",
)
def attempt_ids(spark, sf_dir):
    attempt = F.concat(F.lit("appattempt_"), F.substring("app_id", 13, 100), F.lit("_000002"))
    return demo.events(spark, sf_dir).select(
        "event_id",
        ids.attempt_to_app(attempt).alias("app"),
        ids.attempt_to_short_app(attempt).alias("short_app"),
        ids.short_attempt(attempt).alias("short_attempt"),
        ids.short_app(F.col("app_id")).alias("short_of_app"),
    )


@query(
    "fun11_memory_limit",
    "SELECT l_orderkey, l_linenumber, least(l_partkey, l_orderkey * 100 // 1000)::BIGINT AS limit_kb FROM lineitem",
)
def memory_limit(spark, sf_dir):
    lines = demo.table(spark, sf_dir, "lineitem")
    limit = scalars.memory_limit(F.col("l_partkey"), F.col("l_orderkey") * 100)
    return lines.select("l_orderkey", "l_linenumber", limit.cast("bigint").alias("limit_kb"))


@query(
    "fun12_value_kinds",
    """SELECT l_orderkey, l_linenumber, l_quantity = floor(l_quantity) AS whole_quantity,
      l_discount = floor(l_discount) AS whole_discount, try_cast(l_quantity::VARCHAR AS DOUBLE) AS quantity,
      try_cast(l_returnflag AS BIGINT) AS flag FROM lineitem""",
)
def value_kinds(spark, sf_dir):
    return demo.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scalars.is_integral(F.col("l_quantity")).alias("whole_quantity"),
        scalars.is_integral(F.col("l_discount")).alias("whole_discount"),
        scalars.as_double(F.col("l_quantity").cast("string")).alias("quantity"),
        scalars.as_long(F.col("l_returnflag")).alias("flag"),
    )


@query("fun13_megabytes", "SELECT event_id, round(value / 1000000, 12) AS mb FROM ev")
def megabytes(spark, sf_dir):
    mb = scalars.to_megabytes(F.col("value"))
    return demo.events(spark, sf_dir).select("event_id", F.round(mb, 12).alias("mb"))


@query("fun14_format_millis", "SELECT event_id, ts_text AS text FROM ev")
def format_millis(spark, sf_dir):
    return demo.events(spark, sf_dir).select(
        "event_id", scalars.format_millis(F.unix_millis("ts")).alias("text")
    )


@query(
    "fun15_point_json",
    """SELECT seq, rule_id, group_id, '{"metric":"' || name || '","timestamp":' || (us // 1000) || ',"tags":{"container":"'
      || substr(container_id, 30) || '"}}' AS json FROM cf""",
)
def point_json(spark, sf_dir):
    c = F.create_map(F.lit("container"), ids.short_container(F.col("container_id")))
    body = F.struct(F.col("name").alias("metric"), F.unix_millis("ts").alias("timestamp"), c.alias("tags"))
    return demo.container_facts(spark, sf_dir).select(
        "seq", "rule_id", "group_id", F.to_json(body).alias("json")
    )
