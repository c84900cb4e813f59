"""Substring dedup with prefix-partitioned suffix trees.

A window is `WINDOW` consecutive words of a document; a window whose words also start earlier is a repeat, and the
words it covers go. The steps:

0. All windows of a text that an earlier document has as a whole are repeats: such copies are found by a 96-bit hash
   of the text, get their result at once and send nothing on.
1. Every window names its least 8-word gram (its minimizer, leftmost of equals). Equal windows name the same gram at
   the same place, so a window can only repeat if its gram occurs again. Neighbouring windows of one gram travel
   together as a span of at most 32 words; grams are counted with map-side combine, and only spans of repeated
   grams go on. Nothing that repeats is lost here.
2. The suffixes that start at a gram are partitioned by prefix. The prefix is the 8-word gram as long as no more
   than `GROUP` spans share it; beyond that it is as long as a window, and such a group holds equal windows only.
3. For memory-sized groups a task builds the suffix tree below the prefix in its array form: suffixes in order with
   the length of the common prefix of neighbours. A run of suffixes that share `d` words is a node of depth d. The
   words in front of the gram are ordered the same way, from right to left. The window that begins o words before
   the gram is a repeat where its suffix node of depth 20 - o and its front node of depth o hold an earlier start.
   Groups of window-long prefixes need no tree: the earliest start of each is a minimum, combined in map tasks.
4. Starts that are the first of their windows go back to their documents; all other windows of the spans are removed.

Equal spans of a task become one row before the shuffle (the earliest start), so copies cost a row per task.
Words are compared by 64-bit hash within a group that shares its 8 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import words
from clusterlens.llm.shared import Scratch, slices, text_of

WINDOW = 20
GRAM = 8
PLACES = WINDOW - GRAM + 1
GROUP = 4096
WINDOWS_AT_ONCE = 1 << 17
FOLD_BYTES = 32 << 20
ENTRY_BYTES = 450  # of two tuples, their numbers and a place in the table
FLUSH_ROWS = 8192
CHUNK_ROWS = 40_000
NULL_ID = -(1 << 63)
ROW = "d long, t long"


def _spans(w: words.Words) -> tuple[np.ndarray, ...]:
    """text, lo, n, off, gram of every span: windows lo..lo+n-1 share the gram at lo + off (word numbers within the text)."""
    hashes, text = w.hashes(), w.text
    parts = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
    for begin in range(0, len(hashes) - WINDOW + 1, WINDOWS_AT_ONCE):
        part = slice(begin, begin + WINDOWS_AT_ONCE + WINDOW - 1)
        parts.append(_spans_of(hashes[part], text[part], begin, w.first))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _spans_of(hashes: np.ndarray, text: np.ndarray, begin: int, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of consecutive words, of which the first is number `begin` of the batch."""
    gram, _ = words.grams(hashes, np.array([0, len(hashes)]), GRAM)
    total = len(hashes) - WINDOW + 1
    inside = text[:total] == text[WINDOW - 1 :]
    best, place = gram[:total].copy(), np.zeros(total, dtype=np.int64)
    for k in range(1, PLACES):
        other = gram[k : k + total]
        less = other < best
        best[less], place[less] = other[less], k
    start = np.flatnonzero(inside)
    at = start + place[start]
    new = np.r_[True, (at[1:] != at[:-1]) | (np.diff(start) != 1)] if len(start) else np.zeros(0, bool)
    opens = np.flatnonzero(new)
    lo = start[opens]
    n = np.diff(np.r_[opens, len(start)])
    which = text[lo]
    return which, lo + begin - first[which], n, at[opens] - lo, gram[at[opens]]


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        which, lo, n, off, gram = _spans(words.split(batch.column("text")))
        d, t = (batch.column(c).to_numpy()[which] for c in ("d", "t"))
        code = (lo << 16) | (n << 8) | off
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(d), pa.array(t), pa.array(code)], names=["h", "d", "t", "code"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of earlier texts and documents without spans get their result at once; of the others the text goes on."""
    for batch in slices(batches):
        counts, removed, shas, texts = [], [], [], []
        for text, spans, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "copy")), strict=True):
            found = text.encode().split()
            counts.append(len(found))
            removed.append(len(found) if copy and len(found) >= WINDOW else 0)
            shas.append(hashlib.sha256(b" ".join(found[removed[-1] :])).hexdigest() if not spans else None)
            texts.append(text if spans else None)
        columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
        names = ["d", "t", "n_words", "n_removed", "sha", "text", "spans"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "t")), *columns, batch.column("spans")], names=names)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(d, t, bytes, word starts, word ends, spans) of each document; spans are (lo, n, off, gram, crowded)."""
    for batch in slices(batches):
        w = words.split(batch.column("text"))
        rows = zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True)
        for i, (d, t, spans) in enumerate(rows):
            a, b = w.first[i], w.first[i + 1]
            some = [(s["code"] >> 16, (s["code"] >> 8) & 0xFF, s["code"] & 0xFF, s["h"], s["crowded"]) for s in spans]
            yield d, t, w.data, w.start[a:b], w.end[a:b], some


class _Fold:
    """The earliest start of equal keys; rows leave when their keys fill the buffer."""

    def __init__(self, names: list[str]):
        self.names, self.seen, self.held = names, {}, 0

    def add(self, key: tuple, size: int, start: tuple) -> bool:
        known = self.seen.get(key)
        if known is None:
            self.seen[key] = start
            self.held += size + ENTRY_BYTES
        elif start < known:
            self.seen[key] = start
        return self.held > FOLD_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        while self.seen:
            rows = [(*k, *s) for k, s in (self.seen.popitem() for _ in range(min(FLUSH_ROWS, len(self.seen))))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=self.names)
        self.seen, self.held = {}, 0


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = _Fold(["h", "off", "content", "d", "t", "lo"])
    for d, t, data, start, end, spans in _documents(batches):
        for lo, n, off, gram, crowded in spans:
            if not crowded:
                content = data[start[lo] : end[lo + n + WINDOW - 2]].tobytes()
                if fold.add((gram, off, content), len(content), (d, t, lo)):
                    yield from fold.flush()
    yield from fold.flush()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = _Fold(["content", "d", "t", "lo"])
    for d, t, data, start, end, spans in _documents(batches):
        for lo, n, _, _, crowded in spans:
            for at in range(lo, lo + n) if crowded else ():
                content = b" ".join(data[start[at] : end[at + WINDOW - 1]].tobytes().split())
                if fold.add((content,), len(content), (d, t, at)):
                    yield from fold.flush()
    yield from fold.flush()


def _nodes(group: np.ndarray, side: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """For each depth the node of each row: rows of a group that share that many words of `side` (row, word).

    Rows are sorted once by group and words; a node of depth d is a run of neighbours with d words in common.
    """
    order = np.lexsort((*side.T[::-1], group))
    ordered, g = side[order], group[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), side.shape[1])
    common[g[1:] != g[:-1]] = -1
    out = []
    for depth in range(side.shape[1] + 1):
        node = np.empty(len(order), dtype=np.int64)
        node[order] = np.cumsum(np.r_[0, common < depth])
        out.append(node)
    return out


def first_windows(h: np.ndarray, off: np.ndarray, content: pa.Array, d: np.ndarray, t: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For spans of whole groups: a bit for each of a span's windows that starts nowhere earlier in the group."""
    w = words.split(content)
    hashes = w.hashes()
    size = np.diff(w.first)
    middle = w.first[:-1] + off
    right_size, left_size = np.minimum(size - off, WINDOW), off
    k = np.arange(WINDOW)
    inside = k < right_size[:, None]
    right = np.where(inside, hashes[np.minimum(middle[:, None] + k, len(hashes) - 1)], np.uint64(0))
    k = np.arange(PLACES - 1)
    inside = k < left_size[:, None]
    left = np.where(inside, hashes[np.maximum(middle[:, None] - 1 - k, 0)], np.uint64(0))
    group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
    behind, front = _nodes(group, right, right_size), _nodes(group, left, left_size)
    mask = np.zeros(len(h), dtype=np.int64)
    for o in range(PLACES):
        rows = np.flatnonzero((left_size >= o) & (right_size >= WINDOW - o))
        start = lo[rows] + off[rows] - o
        a, b = behind[WINDOW - o][rows], front[o][rows]
        order = np.lexsort((start, t[rows], d[rows], b, a))
        first = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(rows) else np.zeros(0, bool)
        chosen = rows[order[first]]
        mask[chosen] |= np.int64(1) << (off[chosen] - o)
    return mask


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in gram order become first starts; a chunk holds whole groups."""

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        h, off, d, t, lo = (rows.column(c).to_numpy() for c in ("h", "off", "d", "t", "lo"))
        mask = first_windows(h, off, rows.column("content").cast(pa.string()), d, t, lo)
        some = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (d, t, lo, mask)], names=["d", "t", "lo", "mask"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < CHUNK_ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h = rows.column("h").to_numpy()
        whole = int(np.searchsorted(h, h[-1]))
        if whole:
            yield settle(rows.slice(0, whole))
        held = [rows.slice(whole)]
    if held:
        yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "firsts")), strict=True)
        removed, shas = [], []
        for text, spans, firsts in rows:
            found = text.encode().split()
            repeat = np.zeros(len(found) + 1, dtype=bool)
            for s in spans:
                lo = s["code"] >> 16
                repeat[lo : lo + ((s["code"] >> 8) & 0xFF)] = True
            for f in firsts or ():
                for k in range(f["mask"].bit_length()):
                    if f["mask"] >> k & 1:
                        repeat[f["lo"] + k] = False
            at = np.flatnonzero(repeat)
            edge = np.zeros(len(found) + WINDOW + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge)[: len(found)] > 0
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(b" ".join([w for w, g in zip(found, gone.tolist(), strict=True) if not g])).hexdigest())
        columns = [*(batch.column(c) for c in ("d", "t", "n_words")), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["d", "t", "n_words", "n_removed", "kept_sha256"])


def remove(spark: SparkSession, docs: DataFrame, crowd: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Documents are ordered by id, null first, then by a hash of the text. Rows equal in id and text are one document
    listed more than once: each gets the same result and none is earlier than the other. Null and short texts have
    no window and stay whole. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(spark, "repeats")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), text_of().alias("text"))
    rows = rows.select("d", F.xxhash64("text").alias("t"), F.hash("text").alias("u"), "text")
    texts = rows.groupBy("t", "u").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    texts = scratch.stage(texts.select("t", "u", "first"), "copies")
    copy = F.coalesce(F.col("first") < F.col("d"), F.lit(False)).alias("copy")
    rows = rows.join(texts, ["t", "u"], "left").select("d", "t", "text", copy)
    grams = rows.where("not copy").select("d", "t", "text").mapInArrow(_minimizers, f"h long, {ROW}, code long")
    repeated = scratch.stage(grams.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    crowded = (F.col("n") > crowd).alias("crowded")
    spans = grams.join(repeated, "h").select("d", "t", F.struct("code", "h", crowded).alias("s"))
    spans = spans.groupBy("d", "t").agg(F.collect_set("s").alias("spans"))
    span_type = "array<struct<code:bigint,h:bigint,crowded:boolean>>"
    settled = rows.join(spans, ["d", "t"], "left").select("d", "t", "text", "spans", "copy")
    settled = settled.mapInArrow(_settle, f"{ROW}, n_words long, n_removed long, sha string, text string, spans {span_type}")
    settled = scratch.stage(settled, "settled")
    open_docs = settled.where("text is not null")
    source = open_docs.select("d", "t", "text", "spans")
    firsts = source.mapInArrow(_span_rows, f"h long, off long, content binary, {ROW}, lo long")
    firsts = firsts.repartition("h").sortWithinPartitions("h").mapInArrow(_trees, f"{ROW}, lo long, mask long")
    some = F.exists("spans", lambda s: s["crowded"])
    windows = source.where(some).mapInArrow(_window_rows, f"content binary, {ROW}, lo long")
    windows = windows.groupBy("content").agg(F.min(F.struct("d", "t", "lo")).alias("s")).select("s.*", F.lit(1).cast("long").alias("mask"))
    firsts = firsts.unionByName(windows).groupBy("d", "t").agg(F.collect_list(F.struct("lo", "mask")).alias("firsts"))
    firsts = scratch.stage(firsts, "firsts")
    open_docs = open_docs.dropDuplicates(["d", "t"])
    done = open_docs.join(firsts, ["d", "t"], "left").select("d", "t", "n_words", "text", "spans", "firsts")
    done = done.mapInArrow(_remove, f"{ROW}, n_words long, n_removed long, kept_sha256 string")
    done = scratch.stage(done.select("d", "t", F.col("n_removed").alias("n_gone"), "kept_sha256"), "done")
    out = settled.select("d", "t", "n_words", "n_removed", "sha").join(done, ["d", "t"], "left")
    return out.select(
        F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"),
        "n_words",
        F.coalesce("n_gone", "n_removed").alias("n_removed"),
        F.coalesce("sha", "kept_sha256").alias("kept_sha256"),
    )
