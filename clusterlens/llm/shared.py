"""Folders and files that the driver and all executors reach, and helpers all operators here use.

Everything a run keeps lies below the folder the session names in `spark.checkpoint.dir`. Tables go there as
Parquet; files of a format of their own are written by tasks through `create` and read through `open_input`.
A file counts only once the table that lists it is committed, so a task that is lost or run twice leaves at
most a file nobody reads.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.session import shared_folder

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """The tables and files of one run of an operator, in one folder of the shared store."""

    def __init__(self, spark: SparkSession, label: str):
        root = shared_folder(spark)
        if root is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table once and read it back: lineage ends here and its size is known to the planner."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Remove tables of this run that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def create(uri: str):
    """A new binary file in the shared store."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")  # noqa: SIM115
    store, inner = pafs.FileSystem.from_uri(uri)
    return store.open_output_stream(inner)


def open_input(uri: str):
    """A seekable binary file of the shared store."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")  # noqa: SIM115
    store, inner = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def whole_row(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of `docs` as one struct `row`, beside columns of an operator's own, so that no names can clash."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), *[c.alias(name) for name, c in more.items()])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of a text column, or one longer text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if len(lengths) > first:
            yield batch.slice(first)
