"""Exact dedup through an extendible-hash index on shared files.

1. One pass stores a 64-bit hash, the SHA-256 and a row number of every text; the texts stay where they are.
2. Hashes that occur more than once get a directory. Buckets are ranges of hash prefixes; one that holds more
   than `capacity` bytes of text splits by its next bit, which doubles the directory where its depth grows.
3. Map tasks fold equal texts (bytes compared) before the shuffle, so a group that holds a third of all rows
   sends one row per task and flush. Owner tasks get whole buckets in hash order, chain texts whose hashes
   collide, compare bytes, and write the entries of their key range.
4. Every row looks up its entry by hash and digest; a hash that occurs once is its own group.

A single hash cannot be split further and makes a bucket of its own, however large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.shared import Scratch, text_of, whole_row

CAPACITY = 64 << 10
MOST_BUCKETS = 1 << 18
FOLD_BYTES = 32 << 20
STEP = 4
DEEPEST = 60


def row_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Hash, digest, length and a number of its own for every row."""
    text = text_of(text_column)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(text).alias("h"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def _prefix(depth: int):
    return F.shiftrightunsigned("h", 64 - depth)


def directory(spark: SparkSession, keys: DataFrame, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Buckets as (prefix, depth) in hash order, each with at most `capacity` bytes or too deep to split.

    `keys` has a row (h, bytes) per distinct hash. A round counts only overfull buckets, `STEP` bits deeper.
    The capacity grows with the table where more than `MOST_BUCKETS` buckets would be needed.
    """
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacity = max(capacity, -(-2 * total // MOST_BUCKETS))
    done: list[tuple[int, int]] = []
    full = [(0, 0)] if total > capacity else []
    if not full:
        return [(0, 0)]
    depth = 0
    while full:
        depth += STEP
        rows = keys
        if depth > STEP:
            which = spark.createDataFrame([(p,) for p, _ in full], "prefix long")
            rows = rows.withColumn("prefix", _prefix(depth - STEP)).join(which, "prefix", "left_semi")
        load = dict(rows.groupBy(_prefix(depth).alias("p")).agg(F.sum("bytes")).toLocalIterator())
        split = full
        for d in range(depth - STEP + 1, depth + 1):  # doubling, one bit at a time
            at = {}
            for p, x in load.items():
                at[p >> (depth - d)] = at.get(p >> (depth - d), 0) + x
            halves = [(2 * p + bit, d) for p, _ in split for bit in (0, 1)]
            split = [b for b in halves if at.get(b[0], 0) > capacity]
            done += [b for b in halves if at.get(b[0], 0) <= capacity]
        full = split if depth < DEEPEST else []
        done += split if depth >= DEEPEST else []
    return sorted(done, key=lambda b: b[0] << (64 - b[1]))


def _fold(starts: np.ndarray, flush: int):
    """Equal texts of a task become one row: the greatest id, how many rows bear it, and the number of copies."""

    def bucket(h: int) -> int:
        return int(np.searchsorted(starts, np.uint64(h & 0xFFFFFFFFFFFFFFFF), side="right")) - 1

    def emit(seen: dict) -> pa.RecordBatch:
        rows = [(bucket(h), h, sha, text, *best, n) for (h, text), (sha, best, n) in seen.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOLDED.types, strict=True)], schema=_FOLDED
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = {}, 0
        for batch in batches:
            for h, sha, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = seen.get((h, text))
                if known is None:
                    seen[h, text] = [sha, (doc, 1), 1]
                    held += len(text) + 200
                    if held > flush:
                        yield emit(seen)
                        seen, held = {}, 0
                else:
                    known[1] = _later(known[1], (doc, 1))
                    known[2] += 1
        if seen:
            yield emit(seen)

    return run


_FOLDED = pa.schema(
    [("bucket", pa.int32()), ("h", pa.int64()), ("sha", pa.binary()), ("text", pa.string()), ("keep_id", pa.int64()), ("n_best", pa.int64()), ("n", pa.int64())]
)
_ENTRY = pa.schema(
    [("bucket", pa.int32()), ("h", pa.int64()), ("chain", pa.int32()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("n_best", pa.int64()), ("group_size", pa.int64())]
)
FOLDED = "bucket int, h long, sha binary, text string, keep_id long, n_best long, n long"
ENTRY = "bucket int, h long, chain int, sha binary, keep_id long, n_best long, group_size long"


def _later(a: tuple, b: tuple) -> tuple:
    """The greater id, null first, and how many rows bear it."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1]
    return b if a[0] is None or (b[0] is not None and b[0] > a[0]) else a


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (bucket, h) order become index entries; texts of one hash form a chain."""

    def close(bucket, h, chain) -> list[tuple]:
        if len({sha for _, sha, _, _ in chain}) < len(chain):
            raise ValueError(f"different texts with equal hash and digest, hash {h}")
        return [(bucket, h, i, sha, *best, n) for i, (_, sha, best, n) in enumerate(chain)]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY
        )

    at, chain, out = None, [], []
    for batch in batches:
        for bucket, h, sha, text, keep_id, n_best, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (bucket, h):
                if chain:
                    out += close(*at, chain)
                at, chain = (bucket, h), []
            for link in chain:
                if link[0] == text:
                    link[2], link[3] = _later(link[2], (keep_id, n_best)), link[3] + n
                    break
            else:
                chain.append([text, sha, (keep_id, n_best), n])
        if len(out) > 10_000:
            yield emit(out)
            out = []
    if chain:
        out += close(*at, chain)
    if out:
        yield emit(out)


def build_index(spark: SparkSession, docs: DataFrame, keys: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """The stored index: one entry per distinct text among hashes that occur more than once."""
    repeated = scratch.stage(
        keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")).where("n > 1").select("h", "bytes"), "repeated"
    )
    buckets = directory(spark, repeated, capacity)
    starts = np.array([p << (64 - d) if d else 0 for p, d in buckets], dtype=np.uint64)
    rows = docs.select(F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("sha"), "doc_id", "text")
    rows = rows.join(repeated.select("h"), "h", "left_semi").select("h", "sha", "doc_id", "text")
    folded = rows.mapInArrow(_fold(starts, FOLD_BYTES), FOLDED)
    owned = folded.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(_own, ENTRY)
    return scratch.stage(owned, "index")


def groups(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays, null
    ids last of all; of rows that repeat both id and text just one stays. Other columns are not read, so their names
    cannot clash. An empty table gives no rows.
    """
    scratch = Scratch(spark, "exact")
    keys = scratch.stage(row_keys(docs, id_column, text_column), "keys")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    index = build_index(spark, texts, keys, scratch, capacity)
    key = ["h", "sha"]
    bears = (F.col("doc_id").eqNullSafe(F.col("other"))).alias("bears")
    several = index.where("n_best > 1").select(*key, F.col("keep_id").alias("other"))
    first = keys.join(several, key).where(bears).groupBy(*key).agg(F.min("row").alias("first_row"))
    entry = index.select(*key, F.col("keep_id").alias("other"), F.col("group_size").alias("n"))
    entry = scratch.stage(entry.join(first, key, "left"), "entries")
    found = keys.select("doc_id", "row", *key).join(entry, key, "left")
    single = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("other")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (bears & (F.col("first_row").isNull() | (F.col("row") == F.col("first_row"))))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_decided(scratch: Scratch, docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns unchanged; `decided` tells (doc_id, sha, kept) of rows in groups.

    Rows are dropped by (doc_id, digest). Where a row that stays shares both with rows that go, the rows are
    identical in id and text, and one of them is taken.
    """
    by = decided.groupBy("doc_id", "sha").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    by = scratch.stage(by.where("not stays or n > 1"), "touched")
    keyed = whole_row(docs, doc_id=F.col("doc_id"), digest=F.unhex(F.sha2(text_of(), 256)))
    same = keyed["doc_id"].eqNullSafe(by["doc_id"]) & (keyed["digest"] == by["sha"])
    # one plan at every size: what grows with the table is not sent to all tasks while it is still small
    rest = keyed.join(by.hint("merge"), same, "left_anti").select("row.*")
    if by.where("stays").isEmpty():
        return rest
    repeated = keyed.join(by.where("stays").hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return rest.unionByName(repeated.select("row.*"))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of rows with equal texts the one with the largest id, all columns unchanged, whatever their names.

    Null counts as the empty text; null ids go last; of rows that repeat id and text one stays. An empty table gives no rows.
    """
    scratch = Scratch(spark, "exact-rows")
    decided = groups(spark, docs).where("group_size > 1").select("doc_id", F.unhex("text_sha256").alias("sha"), "kept")
    return keep_decided(scratch, docs, scratch.stage(decided, "decided"))
