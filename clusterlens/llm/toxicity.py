"""Toxicity by classifier chains.

Categories are predicted in turn. Each has a logistic model over counts of words and word beginnings, and the
probabilities of all categories before it. A later model is trained on out-of-fold probabilities of the earlier
ones (each document scored by models that did not see it), so it learns how far they can be trusted; at use the
earlier models are those fitted on the whole sample.

The labels tell toxic or not. The categories before it are kinds of toxic documents that the sample shows by itself: its
toxic documents fall into two groups by their terms (two means by cosine, from the two least alike), whatever the language.
Models are fitted on a bounded sample (`SAMPLE_DOCS` labelled documents with the least hash): map tasks count in
how many toxic and other documents each term stands, the `FEATURES` terms with the largest log odds are kept.
The threshold is the one with the best F1 over the sample's out-of-fold probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.shared import slices, text_of

SAMPLE_DOCS = 8000
FEATURES = 500
LEAST_DOCS = 4
FOLDS = 5
STEPS = 200
RATE = 0.3
RIDGE = 3e-4
PREFIXES = (4, 5, 6)
KINDS = 2
CHAIN = ("first_kind", "second_kind", "toxic")
TABLE_ENTRIES = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, which end with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    vocabulary: list[str]
    weights: list[np.ndarray]  # per category: terms, then earlier categories, then the constant
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Chain of probabilities (row, category) for counts already as log(1 + n)."""
        out = np.zeros((len(x), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = _predict(w, np.hstack([x, out[:, :k]]))
        return out


def _predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by adaptive gradient ascent; both classes count alike."""
    w = np.zeros(x.shape[1] + 1)
    n = np.bincount(y.astype(int), minlength=2)
    each = np.where(y > 0, 0.5 / max(n[1], 1), 0.5 / max(n[0], 1))
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        miss = (y - _predict(w, x)) * each
        grad = np.append(x.T @ miss - RIDGE * w[:-1], miss.sum())
        speed += grad * grad
        w += RATE * grad / np.sqrt(speed + 1e-12)
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Final weights of each category and the out-of-fold probabilities; `y` has a column per category."""
    early = np.zeros((len(x), y.shape[1]))
    weights = []
    for k in range(y.shape[1]):
        seen = np.hstack([x, early[:, :k]])
        for f in range(FOLDS):
            rest, here = fold != f, fold == f
            if rest.any() and here.any():
                early[here, k] = _predict(_logistic(seen[rest], y[rest, k]), seen[here])
        weights.append(_logistic(seen, y[:, k]))
    return weights, early


def kinds_of(x: np.ndarray, steps: int = 50) -> np.ndarray:
    """The group of each row: two means by cosine, begun at the first row and the row least like it; the larger group is 0."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(length > 0, length, 1)
    if not len(unit):
        return np.zeros(0, dtype=int)
    center = unit[[0, int(np.argmin(unit @ unit[0]))]]
    group = np.full(len(unit), -1)
    for _ in range(steps):
        nearest = (unit @ center.T).argmax(axis=1)
        if (nearest == group).all():
            break
        group = nearest
        means = [unit[group == k].mean(axis=0) if (group == k).any() else center[k] for k in range(KINDS)]
        center = np.stack([m / (np.linalg.norm(m) or 1) for m in means])
    return group if (group == 0).sum() * 2 >= len(group) else 1 - group


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap above which F1 is best."""
    if not len(p) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    last = np.r_[p[order][1:] != p[order][:-1], True]
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents of this task each term stands."""
    counts = (Counter(), Counter())
    for batch in slices(batches):
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts[toxic].update({t for w in set(words_of(text)) for t in terms_of(w)})
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"term": some, "other": [counts[0][t] for t in some], "toxic": [counts[1][t] for t in some]})


def _hits(vocabulary: list[str]):
    """A function from a text to its counts per feature, with a table of the features of words seen."""
    number = {t: i for i, t in enumerate(vocabulary)}
    table: dict[str, tuple[int, ...]] = {}

    def hits(text: str) -> Counter:
        found: Counter = Counter()
        for w in words_of(text):
            f = table.get(w)
            if f is None:
                f = tuple(number[t] for t in terms_of(w) if t in number)
                if len(table) < TABLE_ENTRIES:
                    table[w] = f
            if f:
                found.update(f)
        return found

    return hits


def _sample_rows(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _hits(vocabulary)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [hits(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("toxic"),
                    pa.array([list(f) for f in found], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.int32())),
                    batch.column("fold"),
                ],
                names=["doc_id", "toxic", "features", "counts", "fold"],
            )

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Fit the chain on the `sample` labelled documents with the least hash of their id."""
    told = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(told, "doc_id")
    rows = rows.select("doc_id", (F.col("toxic") > 0).alias("toxic"), "text", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    counts = rows.select("toxic", "text").mapInArrow(_count_terms, "term string, other long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).where(f"other + toxic >= {LEAST_DOCS}")
    n = rows.groupBy("toxic").count().toLocalIterator()
    size = {r["toxic"]: r["count"] for r in n}
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(size.get(True, 0)) + 1.0)) - F.log((F.col("other") + 0.5) / (F.lit(size.get(False, 0)) + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    best = counts.select("term", F.abs(odds / spread).alias("z")).orderBy(F.desc("z"), "term").limit(FEATURES)
    vocabulary = sorted(r.term for r in best.toLocalIterator())
    got = rows.mapInArrow(_sample_rows(vocabulary), "doc_id long, toxic boolean, features array<int>, counts array<int>, fold int")
    got = sorted(got.toLocalIterator(), key=lambda r: (r.doc_id, r.features, r.counts))
    x = np.zeros((len(got), len(vocabulary)))
    for i, r in enumerate(got):
        x[i, r.features] = np.log1p(r.counts)
    y = np.zeros((len(got), len(CHAIN)))
    y[:, -1] = [r.toxic for r in got]
    toxic = np.flatnonzero(y[:, -1])
    y[toxic, kinds_of(x[toxic])] = 1
    weights, early = fit_chain(x, y, np.array([r.fold for r in got], dtype=int))
    return Model(vocabulary, weights, best_threshold(early[:, -1], y[:, -1]))


def _score(model: Model):
    names = ["doc_id", *(f"{c}_probability" for c in CHAIN), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _hits(model.vocabulary)
        for batch in slices(batches):
            x = np.zeros((len(batch), len(model.vocabulary)))
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = hits(text)
                if found:
                    x[i, list(found)] = np.log1p(list(found.values()))
            p = model.probabilities(x)
            toxic = (p[:, -1] >= model.threshold) & x.any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in p.T), pa.array(toxic)], names=names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, the probability of each category, and toxic.

    Null and empty texts, and texts without any feature, are not toxic. Repeated rows stay; other columns are not
    read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    columns = ", ".join(f"{c}_probability double" for c in CHAIN)
    return rows.mapInArrow(_score(model), f"doc_id long, {columns}, toxic boolean")
