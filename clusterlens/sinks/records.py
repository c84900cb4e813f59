"""Keyed records and time-series points as output rows, and writers for them."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.functions import ids, scalars
from clusterlens.operators.extract import unqualify
from clusterlens.operators.metrics import METRIC_FIELDS

POINTS_PER_PAYLOAD = 1000


def to_log_messages(lines: DataFrame) -> DataFrame:
    """(key, value) of log lines. Container lines carry their id in front; daemon lines have `source`."""
    if "container_id" in lines.columns:
        source = F.col("container_id")
        value = F.concat_ws(" ", "container_id", "line")
    else:
        source, value = F.col("source"), F.col("line")
    return lines.select(F.concat(source, F.lit("-log")).alias("key"), value.alias("value"))


def to_metric_messages(samples: DataFrame) -> DataFrame:
    """(key, value) of samples: the ten-field comma-separated line, its numbers in plain digits."""
    return samples.select(
        F.concat("container_id", F.lit("-metric")).alias("key"),
        F.concat_ws(
            ",",
            "container_id",
            scalars.format_millis(F.unix_millis("ts")),
            *[scalars.plain_number(F.col(c)) for c in METRIC_FIELDS],
        ).alias("value"),
    )


def _point_ok() -> Column:
    return (F.size("tags") > 0) & F.col("metric").isNotNull()


def to_points(facts: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """Points (metric, timestamp, value, tags): the key without its type, ids in short form."""
    _, name = unqualify(F.col(key))
    return facts.select(
        name.alias("metric"),
        F.unix_millis(ts).alias("timestamp"),
        F.col("value").cast("double").alias("value"),
        ids.short_tags(F.col("tags")).alias("tags"),
    )


def valid_points(points: DataFrame) -> DataFrame:
    return points.where(_point_ok())


def rejected_points(points: DataFrame) -> DataFrame:
    """Points without a name or without any tag."""
    return points.where(~F.coalesce(_point_ok(), F.lit(False)))


def point_json(points: DataFrame) -> DataFrame:
    return valid_points(points).select(
        F.to_json(F.struct("metric", "timestamp", "value", "tags")).alias("json")
    )


def payloads(points: DataFrame, batch: int = POINTS_PER_PAYLOAD) -> DataFrame:
    """JSON arrays of at most `batch` points, built inside each task without a shuffle."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["json"].tolist()
            chunks = [texts[i : i + batch] for i in range(0, len(texts), batch)]
            yield pd.DataFrame(
                {"payload": ["[" + ",".join(c) + "]" for c in chunks], "n": [len(c) for c in chunks]}
            )

    return point_json(points).mapInPandas(pack, "payload STRING, n BIGINT")


def http_post(url: str, body: str) -> str:
    request = urllib.request.Request(
        url, data=body.encode(), headers={"Content-Type": "application/json"}
    )
    with urllib.request.urlopen(request, timeout=30) as answer:  # noqa: S310
        return answer.read().decode()


def put_url(server: str) -> str:
    """Full put address of a time-series server given as host:port."""
    url = server if server.startswith(("http://", "https://")) else f"http://{server}"
    return url if url.endswith("/api/put") else f"{url}/api/put"


def points_foreach_batch(
    server: str, batch: int = POINTS_PER_PAYLOAD, post: Callable[[str, str], str] = http_post
) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` writer of points; any non-blank answer fails the task, so Spark retries it."""
    url = put_url(server)

    def send(rows) -> None:
        for row in rows:
            answer = post(url, row["payload"])
            if answer.strip():
                raise RuntimeError(f"unexpected answer: {answer}")

    def write(points: DataFrame, batch_id: int) -> None:
        payloads(points, batch).foreachPartition(send)

    return write


