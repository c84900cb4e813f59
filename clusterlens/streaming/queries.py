"""Starting, fanning out and flushing streaming queries."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clusterlens.session import shared_folder


class Channel(Protocol):
    """An output that takes each micro-batch of facts; `foreachBatch` callables are channels."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None: ...


def start(
    df: DataFrame,
    sink: Channel,
    name: str,
    checkpoints: str | None = None,
    trigger: str | None = "1 second",
    output_mode: str = "append",
) -> StreamingQuery:
    """Run a stream into a channel; `trigger=None` drains what is there and stops.

    Progress is kept under `checkpoints`, by default the session's shared folder.
    """
    root = checkpoints or shared_folder(df.sparkSession)
    if root is None:
        raise ValueError("name a checkpoint folder: the session has no spark.checkpoint.dir")
    writer = (
        df.writeStream.queryName(name)
        .outputMode(output_mode)
        .option("checkpointLocation", f"{root}/{name}")
        .foreachBatch(sink)
    )
    once = {"availableNow": True} if trigger is None else {"processingTime": trigger}
    return writer.trigger(**once).start()


def fan_out(channels: Sequence[Channel]) -> Channel:
    """One channel that hands each batch to several; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for channel in channels:
                channel(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def append_table(path: str, fmt: str = "parquet") -> Channel:
    """Channel that writes each batch to its own directory, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.format(fmt).mode("overwrite").save(f"{path}/batch_id={batch_id}")

    return write


def with_lateness(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Stream whose stateful operators drop facts older than the watermark."""
    return df.withWatermark(ts, delay)


def split_late(kept: Channel, late: Channel, delay_ms: int, marks: str, ts: str = "ts") -> Channel:
    """Channel that hands late rows to one channel and all others to another, none is lost.

    A row is late if it is older than the latest time of all earlier batches less `delay_ms`, which is the watermark a
    stateful operator would drop it by. That time is one value per batch, kept in a file of its own under `marks`, so a batch
    that is repeated is split in the same way. Rows without a time are not late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            before = spark.read.parquet(f"{marks}/batch_id={batch_id - 1}").first()["latest"]
        batch.persist()
        try:
            latest = batch.agg(F.max(F.unix_micros(ts)).alias("latest"))
            latest = latest.select(F.greatest("latest", F.lit(before).cast("bigint")).alias("latest"))
            latest.write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
            limit = F.lit(before).cast("bigint") - delay_ms * 1000
            is_late = F.coalesce(F.unix_micros(ts) < limit, F.lit(False))
            late(batch.where(is_late), batch_id)
            kept(batch.where(~is_late), batch_id)
        finally:
            batch.unpersist()

    return write


def tick_counts(df: DataFrame, tick: str, delay: str, keys: Sequence[str] = ()) -> DataFrame:
    """Facts per tick; a fact that arrives after its tick was closed is dropped."""
    return (
        with_lateness(df, delay)
        .groupBy(F.window("ts", tick), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("tick"), *keys, "n")
    )


def idle_sessions(
    df: DataFrame, keys: Sequence[str], gap: str = "9 seconds", delay: str = "1 second"
) -> DataFrame:
    """Sessions that end after a pause of `gap`; emitted once the watermark has passed it."""
    return (
        with_lateness(df, delay)
        .groupBy(*keys, F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(
            *keys,
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "n_rows",
        )
    )


def latency(probes: DataFrame, received: Column) -> DataFrame:
    """Probe records (value = send time in ms) with their latency, as points `test` = 1."""
    sent = F.trim("value").try_cast("bigint")
    at = F.unix_millis(received)
    return (
        probes.select(
            F.lit("test").alias("metric"),
            at.alias("timestamp"),
            F.lit(1.0).alias("value"),
            F.create_map(F.lit("container"), F.lit("01_000001")).alias("tags"),
            sent.alias("sent_ms"),
            (at - sent).alias("latency_ms"),
        )
        .where(F.col("sent_ms").isNotNull())
    )


