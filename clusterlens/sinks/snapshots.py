"""Window snapshots as files: Parquet for work, JSON lines for exchange."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.sources.logs import SNAPSHOT_FIELDS, snapshot_number

PREFIX = "sliding_window"


def next_snapshot(spark: SparkSession, path: str) -> int:
    """Next free number under `path`; reads file names only."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        row = files.agg(F.max(snapshot_number(F.col("path"))).alias("n")).first()
    except AnalysisException:
        return 0
    return 0 if row["n"] is None else row["n"] + 1


def snapshot_json(nested: DataFrame) -> DataFrame:
    """Exchange form `{tick: {container: cell}}`, one cell per row, so that no tick becomes one huge row."""
    cell = F.struct(*[F.col(c).alias(f) for f, c in SNAPSHOT_FIELDS.items()])
    body = F.create_map(F.col("tick").cast("string"), F.create_map(F.col("container_id"), cell))
    return nested.select(F.to_json(body).alias("value"))


def write_snapshot(nested: DataFrame, path: str, fmt: str = "parquet") -> str | None:
    """Write the cells as the next snapshot and return its path; nothing happens for an empty store."""
    if nested.isEmpty():
        return None
    target = f"{path}/{PREFIX}{next_snapshot(nested.sparkSession, path)}"
    if fmt == "json":
        snapshot_json(nested).write.text(target)
    else:
        nested.write.format(fmt).save(target)
    return target


def app_cells(cells: DataFrame, finished_apps: DataFrame) -> DataFrame:
    return cells.join(finished_apps.select("app_id"), "app_id", "left_semi")


def write_app_snapshots(cells: DataFrame, finished_apps: DataFrame, path: str) -> None:
    """Cells of finished applications, one directory per application."""
    app_cells(cells, finished_apps).write.partitionBy("app_id").mode("append").parquet(path)
