"""Scans of keyed records, container logs, daemon logs and window snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clusterlens.functions.ids import container_to_app
from clusterlens.functions.scalars import parse_log_ts
from clusterlens.operators.cells import CELL
from clusterlens.sources import tail

RECORD_SCHEMA = "key STRING, value STRING, timestamp TIMESTAMP, offset BIGINT"
# Directory name of a container in a log path.
CONTAINER_DIR = r"/(container_[^/]+)/"


def read_messages(
    spark: SparkSession, options: dict[str, str], format: str = "parquet", streaming: bool = False
) -> DataFrame:
    """Keyed records (key, value, timestamp, offset) from files or, with its connector, from Kafka.

    `options` go to the reader; file formats need `path`. Kafka needs the connector package on the
    classpath and its usual `kafka.bootstrap.servers` and `subscribe` options.
    """
    reader = (spark.readStream if streaming else spark.read).format(format).options(**options)
    if format != "kafka":
        return reader.schema(RECORD_SCHEMA).load()
    return reader.load().select(
        F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "offset"
    )


def _lines(spark: SparkSession, path, encoding: str, **options) -> DataFrame:
    reader = spark.read.options(recursiveFileLookup="true", **options)
    if encoding.lower().replace("-", "") == "utf8":
        return reader.text(path).withColumnRenamed("value", "line")
    # The text source reads UTF-8 only; CSV with no separator and no quoting decodes other charsets
    # and still splits large files by line. Needs spark.sql.legacy.javaCharsets for GBK.
    return (
        reader.schema("line STRING")
        .options(encoding=encoding, sep="\x01", quote="", escape="", comment="")
        .csv(path)
    )


def read_container_logs(
    spark: SparkSession,
    root: str,
    streaming: bool = False,
    encoding: str = "utf-8",
    from_end: bool = False,
) -> DataFrame:
    """Every line below the container directories under `root`; the directory names the container.

    `seq` orders the lines of a file: the row's place in a batch scan, the line's first byte in a stream. A stream delivers a
    line when it is complete; with `from_end` it skips what is there when it first starts.
    """
    if streaming:
        lines = tail.scan(spark, root, True, encoding=encoding, startingOffsets="latest" if from_end else "earliest")
        path, seq = F.col("path"), F.col("seq")
    else:
        lines = _lines(spark, root, encoding)
        path, seq = F.col("_metadata.file_path"), F.monotonically_increasing_id()
    lines = lines.select(
        F.regexp_extract(path, CONTAINER_DIR, 1).alias("container_id"), path.alias("path"), "line", seq.alias("seq")
    )
    return lines.where(F.col("container_id") != "")


def read_daemon_log(
    spark: SparkSession,
    path: str,
    source: str,
    since: str | None = None,
    streaming: bool = False,
    encoding: str = "utf-8",
    from_end: bool = False,
    **options,
) -> DataFrame:
    """Lines (source, line, seq) of a daemon log; with `since` (timestamp text) only lines of that time or later.

    A line without a time has that of the last line before it in its file that has one, so a stack trace goes with the line
    it follows; what comes before the first time in a file is left out by `since`. A batch scan without `since` numbers rows
    by their place, all others by the line's first byte. `from_end` lets a stream skip what is there when it first starts.
    """
    if since is None and not streaming:
        lines = _lines(spark, path, encoding)
        return lines.select(F.lit(source).alias("source"), "line", F.monotonically_increasing_id().alias("seq"))
    start = {"startingOffsets": "latest" if from_end else "earliest"}
    lines = tail.scan(spark, path, streaming, encoding=encoding, **start, **options)
    if since is not None:
        lines = lines.where(parse_log_ts(F.col("dated")) >= F.lit(since).cast("timestamp"))
    return lines.select(F.lit(source).alias("source"), "line", "seq")


def containers_of_new_apps(
    containers: DataFrame, apps: DataFrame, since: Column | None = None
) -> DataFrame:
    """Containers whose application was first seen at or after `since` (all listed ones without it)."""
    first = apps.groupBy("app_id").agg(F.min("ts").alias("_first_seen"))
    fresh = first if since is None else first.where(F.col("_first_seen") >= since)
    return (
        containers.withColumn("app_id", container_to_app(F.col("container_id")))
        .join(fresh, "app_id", "left_semi")
    )


_MESSAGE = "STRUCT<key STRING, identifiers MAP<STRING,STRING>, value DOUBLE>"
# Fixed field names of a snapshot cell and the column each one becomes.
SNAPSHOT_FIELDS = {
    "containerId": "container_id",
    "appId": "app_id",
    "timestamp": "tick",
    "CPU": "cpu",
    "memory": "memory",
    "diskServiceByte": "disk_service_byte",
    "diskServiceTime": "disk_service_time",
    "diskWaitTime": "disk_wait_time",
    "diskIOTime": "disk_io_time",
    "netRate": "net_rate",
    "periodMessages": "period_messages",
    "instantMessages": "instant_messages",
}
_FIELD_TYPES = {"containerId": "STRING", "appId": "STRING", "timestamp": "BIGINT"}
_MAPS = ("periodMessages", "instantMessages")
SNAPSHOT_CELL = "STRUCT<{}>".format(
    ", ".join(
        f"{f} " + (f"MAP<STRING, ARRAY<{_MESSAGE}>>" if f in _MAPS else _FIELD_TYPES.get(f, "DOUBLE"))
        for f in SNAPSHOT_FIELDS
    )
)


def read_snapshots(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells of snapshot files, one JSON object `{tick: {container: cell}}` per line.

    A file may hold the whole store in one line or, as `write_snapshot_json` writes it, one cell per
    line; the second form splits over tasks.
    """
    return _snapshot_cells(spark.read.text(paths))


def _snapshot_cells(lines: DataFrame) -> DataFrame:
    lines = lines.select(
        F.col("_metadata.file_path").alias("source"),
        F.from_json("value", f"MAP<STRING, MAP<STRING, {SNAPSHOT_CELL}>>").alias("ticks"),
    )
    per_tick = lines.select("source", F.explode("ticks").alias("_tick", "cells"))
    per_cell = per_tick.select("source", "_tick", F.explode("cells").alias("_container", "cell"))
    return per_cell.select(
        "source",
        F.col("_tick").cast("bigint").alias("tick"),
        F.col("_container").alias("container_id"),
        *[
            F.col(f"cell.{field}").alias(column)
            for field, column in SNAPSHOT_FIELDS.items()
            if column not in CELL
        ],
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all snapshots below `path`, Parquet and JSON alike, with the file they come from as `source`."""
    files = spark.read.option("recursiveFileLookup", "true")
    json = _snapshot_cells(files.option("pathGlobFilter", "*.{txt,json}").text(path))
    columns = [c for c in json.columns if c != "source"]
    schema = StructType([json.schema[c] for c in columns])
    parquet = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(schema).parquet(path)
    return json.unionByName(parquet.select(F.col("_metadata.file_path").alias("source"), *columns))


def snapshot_number(source: Column) -> Column:
    """Number in a snapshot's name `sliding_window<N>`."""
    return F.regexp_extract(source, r"sliding_window(\d+)", 1).try_cast("bigint")


def merge_snapshots(cells: DataFrame, number: Column) -> DataFrame:
    """One store from several snapshots: a later file replaces the whole tick of an earlier one."""
    rows = cells.withColumn("_number", number)
    latest = rows.groupBy("tick").agg(F.max("_number").alias("_number"))
    return rows.join(latest, ["tick", "_number"], "left_semi").drop("_number")


def snapshot_messages(cells: DataFrame) -> DataFrame:
    """Long form of the message maps of snapshot cells."""
    both = None
    for kind in ("period", "instant"):
        lists = cells.select(
            *CELL, "app_id", F.explode(f"{kind}_messages").alias("_key", "_list")
        )
        rows = lists.select(
            *CELL, "app_id", F.lit(kind).alias("kind"), F.posexplode("_list").alias("seq", "_m")
        )
        rows = rows.select(
            *CELL,
            "app_id",
            "kind",
            "_m.key",
            "_m.identifiers",
            "_m.value",
            F.col("seq").cast("bigint").alias("seq"),
        )
        both = rows if both is None else both.unionByName(rows)
    return both
