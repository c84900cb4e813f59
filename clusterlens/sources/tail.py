"""Log files as a source that knows its place: lines in file order, from any byte on, batch or stream.

An offset is the end of the last complete line of each file, so a batch of a stream is a byte range per file, a restarted query
reads on where it stopped, and a line is delivered once, when it is complete. Ranges are cut into tasks of `bytesPerTask`; a line
belongs to the task in whose range it begins. `seq` is the byte at which a line begins, so lines of one file have increasing `seq`.

`dated` is the time at the start of the line or, for a line without one (a stack trace), of the last line before it in the file
that has one. A task finds what is handed over to it by reading backwards from its first byte, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from clusterlens.functions.scalars import LOG_TIME

NAME = "clusterlens_log"
SCHEMA = "path STRING, line STRING, seq BIGINT, dated STRING"
BYTES_PER_TASK = 64 << 20
BLOCK = 1 << 16
ROWS_PER_BATCH = 10_000


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in [begin, end); where `inside`, the first of them begins behind the next line end."""

    path: str
    begin: int
    end: int
    inside: bool


class Files:
    """The log files below a path, of any file system, and how to read pieces of them."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.encoding = options.get("encoding", "utf-8")
        self.bytes_per_task = int(options.get("bytespertask", BYTES_PER_TASK))
        self.known: dict[str, tuple[int, int]] = {}

    def _system(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root)

    def sizes(self) -> dict[str, int]:
        system, root = self._system()
        info = system.get_file_info(root)
        if info.type == pafs.FileType.Directory:
            found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        else:
            found = [info]
        return {f.path: f.size for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}

    def ends(self) -> dict[str, int]:
        """End of the last complete line of each file; only files that have changed are looked into."""
        system, _ = self._system()
        for path, size in self.sizes().items():
            if self.known.get(path, (None, 0))[0] != size:
                with system.open_input_file(path) as file:
                    self.known[path] = (size, _line_start(file, size))
        return {path: end for path, (_, end) in sorted(self.known.items())}

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        out = []
        for path, upto in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if upto < begin else begin  # a file that shrank was begun anew
            for at in range(begin, upto, self.bytes_per_task):
                out.append(Piece(path, at, min(at + self.bytes_per_task, upto), at > begin))
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        with system.open_input_file(piece.path) as file:
            at = _line_end(file, piece.begin - 1) if piece.inside else piece.begin
            dated = _date_before(file, at, self.encoding)
            rows: list[tuple] = []
            for seq, raw in _lines(file, at, piece.end):
                line = raw.decode(self.encoding, "replace")
                found = _TIME.match(line)
                dated = found.group() if found else dated
                rows.append((piece.path, line, seq, dated))
                if len(rows) >= ROWS_PER_BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


_TIME = re.compile(LOG_TIME, re.ASCII)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.string())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "line", "seq", "dated"])


def _line_start(file, at: int) -> int:
    """Where the line that holds byte `at` begins, or `at` itself right behind a line end."""
    while at > 0:
        begin = max(0, at - BLOCK)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def _line_end(file, at: int) -> int:
    """The byte behind the first line end at or after `at`."""
    file.seek(at)
    while block := file.read(BLOCK):
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return at


def _lines(file, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, text) of the complete lines that begin in [at, end)."""
    file.seek(at)
    parts: list[bytes] = []
    start = at
    while start < end and (block := file.read(BLOCK)):
        *whole, rest = block.split(b"\n")
        for text in whole:
            line = b"".join([*parts, text])
            parts = []
            yield start, line.removesuffix(b"\r")
            start += len(line) + 1
            if start >= end:
                return
        if rest:
            parts.append(rest)


def _date_before(file, at: int, encoding: str) -> str | None:
    """Time of the last line before `at` that begins with one."""
    while at > 0:
        begin = _line_start(file, at - 1)
        file.seek(begin)
        found = _TIME.match(file.read(min(at - begin, 64)).decode(encoding, "replace"))
        if found:
            return found.group()
        at = begin
    return None


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = Files(options)

    def partitions(self) -> list[Piece]:
        return self.files.pieces({}, self.files.ends()) or [Piece("", 0, 0, False)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition) if partition.end else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.files = Files(options)
        self.from_end = options.get("startingoffsets", "earliest") == "latest"

    def initialOffset(self) -> dict:  # noqa: N802
        return self.files.ends() if self.from_end else {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.files.ends()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.files.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def scan(spark: SparkSession, path: str, streaming: bool = False, **options):
    """Lines below `path` (path, line, seq, dated). Options: `encoding`, `bytesPerTask`, and for streams
    `startingOffsets` (`earliest`, or `latest` to skip what is there at the first start).

    A last line without a line end is not delivered before it has one. Files whose names begin with `.` or `_` are no logs.
    """
    spark.dataSource.register(LogSource)
    reader = spark.readStream if streaming else spark.read
    return reader.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)
