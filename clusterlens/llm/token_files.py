"""Token-id files: documents as id arrays, each compressed alone with one shared zstandard dictionary.

A shard is  magic, dictionary id | one zstandard frame per document | index | footer.  The index has per document
its id, offset, compressed length, ids, and ids before it in the shard; the footer has where the index starts and
its length. Frames hold ids as little-endian unsigned 16-bit integers where all of the document's ids fit, else
32-bit ones. The dictionary is its own file, named by its SHA-256, which every shard repeats; a reader refuses
another. A short document is read by its index row alone, without the rest of the shard.

Documents are dealt by ranges of their id, so shards in order hold all documents in ascending id order, null ids
first. A document is encoded by pieces that no merge crosses (a space before a non-space starts one, so do a line feed and a mark after a letter or digit), each
distinct piece once per task; a table that holds `TABLE_ENTRIES` pieces takes no more, and further
pieces are encoded once per batch.

The dictionary only affects the size of files, never what they hold. It is trained on `SAMPLE_DOCS` documents of the
whole table, shared evenly among sources as far as these have documents, those with the least hash in each, and on
`SAMPLE_IDS` ids of each around a hashed place of its text.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm.shared import Scratch, create, open_input, slices, text_of

END_ID = 0
MAGIC = b"CLTOK1\x00\x00"
SAMPLE_DOCS = 1000
SAMPLE_IDS = 1 << 10
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
TABLE_ENTRIES = 3 << 19
LONG_PIECE = 1000
CUT = "\x00"
LEVEL = 3
INDEX = np.dtype([("has_id", "<i8"), ("doc_id", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("n", "<i8"), ("before", "<i8")])
FOOTER = struct.Struct("<QQ8s")
SHARDS = "part int, seq int, path string, n_docs long, n_ids long, bytes long"
ROWS = "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long"
_CUT = re.compile(r"(?= \S)")


def _bytes(*parts: tuple[int, int] | int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for p in parts:
        out[p if isinstance(p, int) else slice(p[0], p[1] + 1)] = True
    return out


_ALNUM = _bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_SOLID = _bytes((0x21, 0x7E))  # printable, no space
_OPENS = _SOLID | _bytes((0xC3, 0xDF), (0xE4, 0xEE))  # first bytes of characters that are no white space
_SPACES, _MARKS, _FEED = _bytes(0x20, 0x0A), _bytes(0x2C, 0x2E), 0x0A


def plain_texts(texts: list[str | None]) -> np.ndarray:
    """Texts in which every space and line feed starts a piece, and every comma and point ends a letter or digit.

    Judged by bytes: a Latin letter counts as one by its two bytes; whatever is not surely so makes a text not plain.
    """
    raw = [(t or "").encode() for t in texts]
    at = np.r_[0, np.cumsum([len(r) + 1 for r in raw])]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    if len(data) < 3:
        return np.zeros(len(texts), dtype=bool)
    odd = np.zeros(len(data), dtype=bool)
    here = np.flatnonzero(_SPACES[data])
    odd[here] = ~_OPENS[data[np.minimum(here + 1, len(data) - 1)]]
    odd[at[1:] - 1] = False  # the feeds put between texts
    feeds = here[data[here] == _FEED]
    marks = np.flatnonzero(_MARKS[data])
    for some, good in ((feeds, _SOLID), (marks, _ALNUM)):
        before, second = data[some - 1], data[some - 2]  # at the very start this looks at the end: a feed
        latin = (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        bad = ~(good[before] | latin)
        if some is feeds:
            bad &= ~np.isin(some, at[1:] - 1)
        odd[some[bad]] = True
    total = np.r_[0, np.cumsum(odd)]
    ends_odd = np.array([r[-1:] in (b" ", b"\n") for r in raw])
    return (total[at[1:] - 1] == total[at[:-1]]) & ~ends_odd


class Encoder:
    """Ids of whole texts through a table of distinct pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table: dict[str, bytes] = {}

    def _learn(self, pieces: set[str], into: dict[str, bytes]) -> None:
        new = list(pieces)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                into[piece] = array("I", e.ids).tobytes()

    def _direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def pieces(self, text: str, plain: bool) -> list[str] | None:
        """Pieces that join to the text; None where the text must be encoded as one."""
        if "<|" in text or CUT in text:  # special tokens are found before pieces are cut
            return None
        if not plain:
            return _CUT.split(text)
        for c in " .,\n":
            text = text.replace(c, CUT + c)
        return text.removeprefix(CUT).split(CUT)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without an end id."""
        cut = [self.pieces(t, p) if t else [] for t, p in zip(texts, plain_texts(texts).tolist(), strict=True)]
        seen = {p for c in cut if c for p in c}
        seen.difference_update(self.table)
        get = self.table
        if len(self.table) + len(seen) > TABLE_ENTRIES or any(len(p) > LONG_PIECE for p in seen):
            get = ChainMap({}, self.table)
            self._learn(seen, get.maps[0])
        else:
            self._learn(seen, get)
        out = []
        for text, c in zip(texts, cut, strict=True):
            out.append(self._direct(text) if c is None else b"".join([get[p] for p in c]))
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray) -> bytes:
    small = not len(ids) or ids.max() < 1 << 16
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if raw[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def _around(place: int, n: int, most: int) -> slice:
    """Of `n` things, `most` around a place, as far as the ends allow."""
    start = max(0, min(place - most // 2, n - most))
    return slice(start, start + most)


def shares(counts: dict[int, int], most: int) -> dict[int, int]:
    """`most` documents dealt evenly to sources, each up to its count; what small ones leave goes to the others."""
    out = {}
    for left, (source, n) in zip(range(len(counts), 0, -1), sorted(counts.items(), key=lambda x: (x[1], x[0])), strict=True):
        out[source] = min(n, (most - sum(out.values())) // left)
    return out


def sample(docs: DataFrame) -> DataFrame:
    """Pieces of the sample (source, text, place); `source` is a hash, `place` a random number for the ids."""
    source = F.xxhash64("source") if "source" in docs.columns else F.lit(0).cast("long")
    known = [F.col("doc_id"), F.octet_length("text")]
    rows = docs.select(source.alias("source"), text_of().alias("text"), *(F.xxhash64(F.lit(x), *known).alias(x) for x in ("dictionary", "piece", "place")))
    # no more sources than documents can be in the sample
    counts = rows.groupBy("source").count().orderBy(F.xxhash64("source"), "source").limit(SAMPLE_DOCS).collect()
    if not counts:
        return rows.select("source", "text", "place").limit(0)
    counts = {r["source"]: r["count"] for r in counts}
    share = shares(counts, SAMPLE_DOCS)
    # hashes that hold the share of a source but for bad luck, so that few rows are sorted
    enough = {k: min(1.0, (n + 6 * n**0.5 + 10) / counts[k]) for k, n in share.items()}
    bound = {k: min(2**63 - 1, int(p * 2**64) - 2**63) for k, p in enough.items()}
    of = lambda known: F.create_map(*(F.lit(x).cast("long") for kv in known.items() for x in kv))[F.col("source")]
    rows = rows.where(F.col("dictionary") <= of(bound))
    n, most = F.char_length("text"), 8 * SAMPLE_IDS
    start = F.greatest(F.lit(0), F.least(F.pmod("piece", F.greatest(n, F.lit(1))) - most // 2, n - most)).cast("int")
    rows = rows.select("source", "dictionary", F.substring("text", start + 1, F.lit(most)).alias("text"), F.pmod("place", F.lit(1 << 31)).alias("place"))
    order = Window.partitionBy("source").orderBy("dictionary", "place", "text")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= of(share)).select("source", "text", "place")


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Dictionary from id arrays of the sample; empty where the sample is too small to train on."""
    rows = sorted(sample(docs).toLocalIterator())
    ids = [np.frombuffer(i, "<u4") for i in encoder(tokenizer).encode([r.text for r in rows])]
    samples = [pack(i[_around(r.place % len(i), len(i), SAMPLE_IDS)]) for i, r in zip(ids, rows, strict=True) if len(i)]
    encoder.cache_clear()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class Shard:
    """Writer of one shard."""

    def __init__(self, folder: str, dictionary: bytes):
        self.path = f"{folder}/{uuid.uuid4().hex}.ids"
        self.file = create(self.path)
        self.file.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.offset, self.n_ids, self.rows = len(MAGIC) + 32, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray, press: zstandard.ZstdCompressor) -> None:
        frame = press.compress(pack(ids))
        self.file.write(frame)
        self.rows.append((doc_id is not None, doc_id or 0, self.offset, len(frame), len(ids), self.n_ids))
        self.offset += len(frame)
        self.n_ids += len(ids)

    def close(self) -> tuple[str, int, int, int]:
        index = np.array(self.rows, dtype=INDEX).tobytes()
        self.file.write(index + FOOTER.pack(self.offset, len(index), MAGIC))
        self.file.close()
        return self.path, len(self.rows), self.n_ids, self.offset + len(index) + FOOTER.size


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known)


def _write(folder: str, tokenizer: str, dictionary: bytes, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, made, shard = _compressor(dictionary), [], None
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches, most=4 << 20):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(batch.column("text").to_pylist()), strict=True):
                shard = shard or Shard(folder, dictionary)
                shard.add(doc_id, np.frombuffer(raw + end, "<u4"), press)
                if shard.offset >= shard_bytes:
                    made.append(shard.close())
                    shard = None
        if shard:
            made.append(shard.close())
        part = TaskContext.get().partitionId()
        for seq, (path, n_docs, n_ids, size) in enumerate(made):
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "bytes": [size]}
            )

    return run


class Reader:
    """Random access to the documents of one shard."""

    def __init__(self, path: str, dictionary: bytes):
        self.file = open_input(path)
        head = self.file.read(len(MAGIC) + 32)
        if head != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not a shard of this dictionary")
        self.file.seek(0, 2)
        self.file.seek(self.file.tell() - FOOTER.size)
        at, length, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: the shard has no end")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(length), dtype=INDEX)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdDecompressor(dict_data=known)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; only its frame is read."""
        row = self.index[i]
        if self.file.tell() != row["offset"]:
            self.file.seek(int(row["offset"]))
        out = unpack(self.press.decompress(self.file.read(int(row["length"]))))
        if len(out) != row["n"]:
            raise ValueError(f"document {i} has {len(out)} ids, its index row says {row['n']}")
        return out

    def find(self, doc_id: int) -> np.ndarray:
        """Ids of the first document with this id."""
        here = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["has_id"] == 1))
        if not len(here):
            raise KeyError(doc_id)
        return self.ids(int(here[0]))

    def close(self) -> None:
        self.file.close()


def read_dictionary(path: str) -> bytes:
    with open_input(path) as f:
        out = f.read()
    if not path.endswith(f"{hashlib.sha256(out).hexdigest()}.dict"):
        raise ValueError(f"{path}: the dictionary has changed")
    return out


def _read(dictionary_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for part, seq, path in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "path")), strict=True):
                dictionary = read_dictionary(dictionary_path) if dictionary is None else dictionary
                reader = Reader(path, dictionary)
                for at in range(0, len(reader.index), 10_000):
                    rows = reader.index[at : at + 10_000]
                    sums = [zlib.crc32(reader.ids(at + i).tobytes()) for i in range(len(rows))]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([part] * len(rows), pa.int32()),
                            "seq": pa.array([seq] * len(rows), pa.int32()),
                            "doc_id": pa.array(rows["doc_id"], mask=rows["has_id"] == 0),
                            "before": pa.array(rows["before"]),
                            "n_tokens": pa.array(rows["n"]),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )
                reader.close()

    return run


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, scratch: Scratch, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """The table of shards (part, seq, path, n_docs, n_ids, bytes) and the path of the dictionary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dictionary = train_dictionary(docs.withColumn("text", text_of()), tokenizer)
    path = f"{scratch.folder('ids')}/{hashlib.sha256(dictionary).hexdigest()}.dict"
    with create(path) as f:
        f.write(dictionary)
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = ordered.mapInArrow(_write(scratch.folder("ids"), tokenizer, dictionary, shard_bytes), SHARDS)
    return scratch.stage(shards, "shards"), path


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32, one row per document.

    `start` counts the ids of all documents before it, `n_tokens` includes the end id. A null text is empty and
    has the end id alone; null ids come first; repeated rows stay, in any order among themselves where id and text
    are equal. Other columns are not read, but `source`, where there is one, for the dictionary. An empty table writes
    no shard and gives no rows.
    """
    scratch = Scratch(spark, "token-files")
    shards, dictionary = write(spark, docs, tokenizer, scratch, shard_bytes)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = scratch.stage(shards.select("part", "seq", before.alias("base")), "bases")
    n = max(1, shards.count())
    rows = shards.select("part", "seq", "path").repartition(n).mapInArrow(_read(dictionary), ROWS)
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
