"""Quality rules: base rules on words, then a linear-chain conditional random field over the lines of a text.

Every line with a word gets numeric features. The field has two labels, content and boilerplate, one weight per
feature and label, and one per pair of neighbouring labels. It is trained by gradient ascent on the log
likelihood over a bounded sample of labelled documents (`SAMPLE_DOCS`, those with the least hash), whose lines bear
the document's label. Viterbi decoding marks the lines; a document stays when at least `LEAST_CONTENT` of its
words stand in content lines. Training looks at the sample only; base figures and decoding cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clusterlens.llm import words
from clusterlens.llm.shared import slices, table, text_of, whole_row

SAMPLE_DOCS = 2000
LEAST_CONTENT = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent
STEPS = 150
RATE = 0.2
RIDGE = 1e-3
SYMBOLS = b"#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ROWS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL = _class(SYMBOLS)
_UPPER = _class(bytes(range(ord("A"), ord("Z") + 1)))
_DIGIT = _class(b"0123456789")
_PIPE = _class(b"|")
_BANG = _class(b"!?")
_PUNCT = _class(b".,;:")
_CLASSES = (_SYMBOL, _UPPER, _DIGIT, _PIPE, _BANG, _PUNCT)
N_FEATURES = len(_CLASSES) + 5


class Lines:
    """Lines with a word of a batch of texts, their features, and the base figures of the texts."""

    def __init__(self, texts: pa.Array):
        w = words.split(texts)
        n_texts = len(w.first) - 1
        hashes, text = w.hashes(), w.text
        new = np.zeros(len(w.data) + 1, dtype=np.int64)
        new[1:] = np.cumsum(w.data == 0x0A)
        line = new[w.start] + text  # a text starts a new line as well
        begins = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        self.n_words = np.diff(np.r_[begins, len(line)])
        self.text = text[begins]
        self.first = np.searchsorted(self.text, np.arange(n_texts + 1))
        # whole lines, from the byte after the last line feed to the next one
        feeds = np.unique(np.r_[-1, np.flatnonzero(w.data == 0x0A), w.text_at[1:-1] - 0.5, len(w.data)])
        left = feeds[np.searchsorted(feeds, w.start[begins]) - 1]
        right = feeds[np.searchsorted(feeds, w.start[begins])]
        left, right = (np.floor(left).astype(np.int64) + 1, np.ceil(right).astype(np.int64))
        whole = words.Words(w.data, w.text_at, left, right, self.first).hashes() if len(begins) else np.zeros(0, np.uint64)
        again = self._again(whole)
        self.figures = {
            "n_words": np.diff(w.first),
            "word_chars": self._sum(self._ahead(_is_start(w.data), w.start, w.end), w.first),
            "n_symbols": self._per_text(_SYMBOL[w.data], w.text_at),
            "n_dup_lines": self._sum(again, self.first),
            "n_repeat_words": self._repeated(hashes, w.first),
        }
        self.features = self._features(w, hashes, begins, again)

    @staticmethod
    def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[at[1:]] - total[at[:-1]]

    @staticmethod
    def _ahead(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[end] - total[start]

    @staticmethod
    def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values)]
        return total[first[1:]] - total[first[:-1]]

    def _again(self, whole: np.ndarray) -> np.ndarray:
        """Lines equal to an earlier one of their text."""
        order = np.lexsort((np.arange(len(whole)), whole, self.text))
        out = np.zeros(len(whole), dtype=bool)
        same = (whole[order][1:] == whole[order][:-1]) & (self.text[order][1:] == self.text[order][:-1])
        out[order[1:][same]] = True
        return out

    @staticmethod
    def _repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Words of each text within a 3-word window that the text has twice or more."""
        n_texts = len(first) - 1
        gram, inside = words.grams(hashes, first, 3)
        at = np.flatnonzero(inside)
        text = np.searchsorted(first, at, side="right") - 1
        key = words.join_hash(gram[at], text.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(hashes), dtype=bool)
        for k in range(3):
            covered[at[twice] + k] = True
        return Lines._sum(covered, first) if n_texts else np.zeros(0, np.int64)

    def _features(self, w: words.Words, hashes: np.ndarray, begins: np.ndarray, again: np.ndarray) -> np.ndarray:
        n = len(begins)
        out = np.zeros((n, N_FEATURES))
        if not n:
            return out
        last = np.r_[begins[1:], len(w.start)] - 1
        left, right = w.start[begins], w.end[last]
        size = np.maximum(right - left, 1)
        for k, kind in enumerate(_CLASSES):
            out[:, k] = self._ahead(kind[w.data], left, right) / size
        same = np.r_[False, hashes[1:] == hashes[:-1]]
        same[begins] = False
        k = len(_CLASSES)
        out[:, k] = np.add.reduceat(same, begins) / self.n_words
        out[:, k + 1] = again
        out[:, k + 2] = np.minimum(size / self.n_words, 40) / 10
        out[:, k + 3] = np.log1p(self.n_words) / 5
        out[:, k + 4] = 1
        return out


def _is_start(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def train(sequences: list[tuple[np.ndarray, int]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, label) and transitions (label, label) of the field.

    `sequences` are line features of a text and its label; each text counts once, whatever its length, and the
    labels count alike. Gradients are those of the log likelihood, by the forward-backward recursions over all
    texts at once.
    """
    weights, moves = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: -len(s[0]))
    if not sequences:
        return weights, moves
    n = np.array([len(x) for x, _ in sequences])
    label = np.array([y for _, y in sequences])
    share = np.bincount(label, minlength=2)
    each = 1 / (2 * np.maximum(share[label], 1) * n)
    at = np.r_[0, np.cumsum(n)]
    features = np.concatenate([x for x, _ in sequences])
    gold = np.zeros((len(features), 2))
    gold[np.arange(len(features)), np.repeat(label, n)] = 1
    row_weight = np.repeat(each, n)
    step_sets = [at[:-1][n > t] + t for t in range(n[0])]
    speed = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(steps):
        score = features @ weights
        forward, backward = np.empty_like(score), np.zeros_like(score)
        forward[step_sets[0]] = score[step_sets[0]]
        for rows in step_sets[1:]:
            forward[rows] = np.logaddexp.reduce(forward[rows - 1][:, :, None] + moves, axis=1) + score[rows]
        for rows in step_sets[:0:-1]:
            backward[rows - 1] = np.logaddexp.reduce(moves + (score[rows] + backward[rows])[:, None, :], axis=2)
        total = np.repeat(np.logaddexp.reduce(forward[at[1:] - 1], axis=1), n)
        belief = np.exp(forward + backward - total[:, None])
        grad = features.T @ ((gold - belief) * row_weight[:, None]) - RIDGE * weights
        inner = np.concatenate(step_sets[1:]) if len(step_sets) > 1 else np.zeros(0, np.int64)
        pair = forward[inner - 1][:, :, None] + moves + (score[inner] + backward[inner])[:, None, :] - total[inner][:, None, None]
        told = gold[inner - 1][:, :, None] * gold[inner][:, None, :]
        grad_moves = ((told - np.exp(pair)) * row_weight[inner][:, None, None]).sum(axis=0) - RIDGE * moves
        for what, g, v in ((weights, grad, speed[0]), (moves, grad_moves, speed[1])):
            v += g * g
            what += RATE * g / np.sqrt(v + 1e-12)
    return weights, moves


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of one text."""
    (aa, ab), (ba, bb) = moves.tolist()
    rows = score.tolist()
    if not rows:
        return np.zeros(0, dtype=np.int64)
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
        back.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
    out = [0 if a >= b else 1]
    for step in reversed(back):
        out.append(step[out[-1]])
    return np.array(out[::-1])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lines = Lines(batch.column("text"))
        rows = [lines.features[a:b].astype("<f4").tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("bad"), pa.array(rows, pa.binary())], names=["bad", "x"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Train on the `sample` labelled documents with the least hash of their id."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").select((F.col("quality") == 0).alias("bad"), "text")
    rows = rows.mapInArrow(_sample_features, "bad boolean, x binary").toLocalIterator()
    sequences = [(np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES).astype(float), int(r.bad)) for r in rows]
    return train(sorted(sequences, key=lambda s: (len(s[0]), s[0].sum())))


def _judge(weights: np.ndarray, moves: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = Lines(batch.column("text"))
            score, counts = lines.features @ weights, lines.n_words
            share = []
            for a, b in zip(lines.first[:-1], lines.first[1:], strict=True):
                label = viterbi(score[a:b], moves)
                share.append(float((counts[a:b] * (label == CONTENT)).sum() / max(counts[a:b].sum(), 1)))
            f = lines.figures
            failed = (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED * f["n_words"])
            kept = ~failed & (np.array(share) >= LEAST_CONTENT)
            columns = [batch.column("doc_id"), *(pa.array(f[c].astype(np.int64)) for c in FIGURES), pa.array(failed), pa.array(kept), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FIGURES, "base_failed", "kept", "content_share"])

    return run


def _filter(weights: np.ndarray, moves: np.ndarray):
    """Rows of (row, text) that are kept."""
    judge = _judge(weights, moves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            plain = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column("text")], names=["doc_id", "text"])
            kept = pa.concat_arrays([b.column("kept") for b in judge([plain])])
            yield batch.select(["row"]).filter(kept)

    return run


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its base figures, base_failed, kept and content_share.

    Null and empty texts have no words, fail the base rules and are not kept. Repeated rows stay. Other columns are
    not read. Without labelled documents all weights are 0 and every line is content. An empty table gives no rows.
    """
    model = fit(spark, docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_judge(*model), ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, all columns unchanged, whatever their names.

    Null and empty texts go. Repeated rows get one verdict and stay or go together. An empty table gives no rows.
    """
    model = fit(spark, docs, labels)
    rows = whole_row(docs, text=text_of())
    return rows.mapInArrow(_filter(*model), StructType([rows.schema["row"]])).select("row.*")


def load_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")
