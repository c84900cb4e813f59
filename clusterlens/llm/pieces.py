"""SentencePiece encoding and decoding by distinct marked words.

Text is normalised to one marker per space with a marker in front, as the model does. Where no piece has a marker
behind another character, no merge crosses the start of a run of markers, so a text is cut there into marked words
(markers and the characters up to the next marker). Each distinct word is segmented once per task by the model
and its ids are put back by position. Words longer than `LONG_WORD` are not kept, and a table of `TABLE_BYTES` takes no
more; such words are segmented once per batch. A text under a model that does not keep the condition is encoded as
one by the library.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from clusterlens.llm.shared import slices, text_of

MARK = "▁"
TABLE_BYTES = 32 << 20
ENTRY_BYTES = 220  # of a key, its ids and a place in the table, besides two bytes a character
LONG_WORD = 1000
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        normal, trainer = spec.normalizer_spec, spec.trainer_spec
        crosses = any(re.search(f"[^{MARK}]{MARK}", p.piece) or p.type == p.USER_DEFINED for p in spec.pieces)
        self.by_words = (
            not crosses
            and normal.name == "identity"
            and normal.add_dummy_prefix
            and normal.escape_whitespaces
            and not normal.remove_extra_whitespaces
            and not trainer.treat_whitespace_as_suffix
        )
        self.table: dict[str, bytes] = {MARK: array("i", [self.model.piece_to_id(MARK)]).tobytes()}
        self.room = TABLE_BYTES

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if not self.by_words:
            return [self.model.encode(t or "") for t in texts]
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen = {w for c in cut for w in c}
        seen.difference_update(self.table, {MARK})
        new = list(seen)
        marked = [w[1:].replace(MARK, " ") for w in new]  # the model puts the first marker in front itself
        found = {w: array("i", ids).tobytes() for w, ids in zip(new, self.model.encode(marked, num_threads=1), strict=True)}
        size = sum(ENTRY_BYTES + 2 * len(w) for w in new)
        if size > self.room or any(len(w) > LONG_WORD for w in new):
            for w in new:  # as many as there is room for; the others serve this batch
                if len(w) <= LONG_WORD and self.room >= (size := ENTRY_BYTES + 2 * len(w)):
                    self.table[w] = found.pop(w)
                    self.room -= size
        else:
            self.table |= found
            self.room -= size
            found = {}
        table = self.table
        if found:
            return [array("i", b"".join([table.get(w) or found[w] for w in c])).tolist() for c in cut]
        return [array("i", b"".join([table[w] for w in c])).tolist() for c in cut]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches, most=2 << 20):
            counts, ids_sha, text_sha = [], [], []
            for ids in model.encode(batch.column("text").to_pylist()):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            ids = pa.array(pieces(path).encode(batch.column("text").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else pieces(path).decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every document; null and empty texts have no ids."""
    return _rows(docs).mapInArrow(_ids(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids give a null text."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(model), "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null counts as empty; repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    return _rows(docs).mapInArrow(_digest(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
