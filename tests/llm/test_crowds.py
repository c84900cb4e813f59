"""Crowds of texts just below the least similarity: classes as of all pairs, comparisons in proportion to the texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import near_dedup

SCHEMA = "doc_id long, text string"


def crowd(rng, n, size=150, edits=5):
    """Texts that change each `edits` words of a text that is not among them; every 40th has a near copy."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    texts = []
    for i in range(n):
        words = list(base)
        if i % 40 == 39:
            words = texts[-1].split()
            words[rng.randrange(size)] = f"x{rng.random()}"
        else:
            for k in rng.sample(range(4, size - 4), edits):
                words[k] = f"x{rng.random()}"
        texts.append(" ".join(words))
    return texts


def least_ids(texts, table, least=near_dedup.LEAST):
    label = list(range(len(texts)))
    for i in range(1, len(texts)):
        j = near_dedup.similarities(pa.array([texts[i]] * i), pa.array(texts[:i]), table)
        for k in np.flatnonzero(j >= least).tolist():
            low, high = sorted((label[i], label[k]))
            label = [low if c == high else c for c in label]
    return label


def counted(spark, texts, monkeypatch):
    """Classes by id, and the comparisons."""
    compared = []
    stage = near_dedup.Scratch.stage

    def counting(self, df, name):
        out = stage(self, df, name)
        if name.startswith("tested-"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_dedup.Scratch, "stage", counting)
    got = near_dedup.classes(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    monkeypatch.undo()
    return {r.doc_id: r.class_id for r in got}, sum(compared)


def test_crowd_below_the_least_similarity(spark, monkeypatch):
    texts = crowd(random.Random(5), 480, 300, 4)
    table = near_dedup.frequencies(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    label = least_ids(texts, table)
    assert len(set(label)) > 200  # many of the crowd are linked to none
    classes, compared = counted(spark, texts, monkeypatch)
    assert [classes[i] for i in range(len(texts))] == label
    assert compared <= 60 * len(texts)


@pytest.mark.parametrize("edits", [1, 4, 12])
def test_outlines_never_exceed_the_differences(edits):
    rng = random.Random(edits)
    texts = crowd(rng, 60, edits=edits) + ["a b c d e " * 40, "a b c d e " * 41, "a b c d e f " * 40, "", "one two", " ".join(crowd(rng, 2, 700))]
    table = 1 + np.random.default_rng(edits).random(near_dedup.COUNTERS) / 4
    owner, gram, count = near_dedup.shingles(pa.array(texts))
    _, at, n = np.unique(gram, return_inverse=True, return_counts=True)
    single = n[at] == 1
    alone = [gram[(owner == i) & single].view(np.int64).tolist() or None for i in range(len(texts))]
    total, weight, parity = near_dedup.outline(pa.array(texts), pa.array(alone, pa.list_(pa.int64())), table)
    each = count * table[near_dedup._counter(gram)]
    assert np.allclose(total, np.bincount(owner, each, minlength=len(texts)))
    assert np.allclose(weight, np.bincount(owner[single], each[single], minlength=len(texts)))
    bits = np.unpackbits(parity.view(np.uint8), axis=1)
    for i in range(len(texts)):
        j = near_dedup.similarities(pa.array([texts[i]] * len(texts)), pa.array(texts), table)
        for k in range(len(texts)):
            if i != k and total[i] + total[k]:
                differences = (total[i] + total[k]) * (1 - j[k]) / (1 + j[k])
                assert weight[i] + weight[k] + table.min() * (bits[i] != bits[k]).sum() <= differences + 1e-6


def test_outlines_leave_every_link(spark):
    texts = crowd(random.Random(8), 200, edits=3)
    table = near_dedup.frequencies(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    owner, gram, _ = near_dedup.shingles(pa.array(texts))
    _, at, n = np.unique(gram, return_inverse=True, return_counts=True)
    alone = [gram[(owner == i) & (n[at] == 1)].view(np.int64).tolist() for i in range(len(texts))]
    total, weight, parity = near_dedup.outline(pa.array(texts), pa.array(alone, pa.list_(pa.int64())), table)
    rows = spark.createDataFrame(list(zip(range(len(texts)), total.tolist(), weight.tolist(), parity.tolist())), "v long, total double, alone double, parity array<long>")
    other = rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns])
    may = near_dedup._may_link(near_dedup.LEAST, float(table.min()))
    kept = {(r.v, r.v_b) for r in rows.join(other, (F.col("v") < F.col("v_b")) & may).collect()}
    linked = set()
    for i in range(len(texts)):
        j = near_dedup.similarities(pa.array([texts[i]] * len(texts)), pa.array(texts), table)
        linked |= {(i, k) for k in range(i + 1, len(texts)) if j[k] >= near_dedup.LEAST}
    assert linked and linked <= kept and len(kept) < len(texts) * (len(texts) - 1) / 2
