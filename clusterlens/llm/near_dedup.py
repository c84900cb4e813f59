"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its 5-word shingles; the weight is the count in the text times a damped inverse
document frequency, 1 + DAMPING * ln(N / df) / ln(N); without the damping, the words in which near copies differ
would outweigh all that a large group shares. Document frequencies of all documents are counted in `COUNTERS` hashed
counters, a table of fixed size; a shingle counts as rare where its counter does not stand out from the mean.

1. Each text draws `BANDS * ROWS` consistent weighted samples; two texts agree in a sample with a probability equal
   to their weighted Jaccard similarity. A band is `ROWS` samples; texts that agree in a band are candidates. At a
   similarity of 0.8 a pair meets in some band with a probability of 0.998, at 0.9 of 0.99999.
2. Equal texts are one node from here on.
3. Texts of a band are compared with its leader, the text that meets most others, not with each other, so a large group of copies
   costs one comparison a text. What a band then still holds in different classes is open, but for texts so near to
   the leader that no text outside their class can be linked to them (one minus weighted Jaccard is a metric).
   Texts in open bands may share a passage rather than be copies; they draw `FINE_BANDS` bands of `FINE_ROWS` samples,
   in which pairs of a similarity of 0.8 meet with a probability of 0.999 and of 0.5 with 0.06. Of a fine band, texts
   of other classes whose sketches (a bit of each sample) leave room for a link are compared with one leader, then with more in each round; a leader that met
   all others leaves, a band in one class is done, and rounds go on until no band is open.
   A band that is open after the first rounds is a crowd just below `LEAST`. Its texts get outlines: total weight, weight of the
   shingles that no other open text has, and for all other shingles a bit per bucket, whether an odd number falls into it. Shingles of
   one text alone, and buckets whose bits differ, are differences of two texts, so outlines bound their distance from below, and
   only pairs are compared that this bound lets be a link; none is lost by it.
4. A pair is a link when the weighted Jaccard similarity of the whole texts is at least `LEAST`. Classes are the
   connected components of links, found by spreading the least label and jumping along labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm import words
from clusterlens.llm.exact_dedup import keep_decided
from clusterlens.llm.shared import Scratch, slices, text_of

SHINGLE = 5
LEAST = 0.8
BANDS = 12
ROWS = 4
COUNTERS = 1 << 20
BLOCKS = 256
FINE_BANDS = 60
FINE_ROWS = 10
LEADERS = 4
SKETCH = 9  # words of 64 bits
SIGMAS = 4.5
PARITY = 16  # words of 64 bits
DAMPING = 0.25


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, hash and count of the distinct shingles of each text, in (text, hash) order."""
    w = words.split(texts)
    gram, inside = words.grams(w.hashes(), w.first, SHINGLE)
    at = np.flatnonzero(inside)
    text = w.text[at]
    order = np.lexsort((gram[at], text))
    text, gram = text[order], gram[at][order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])]) if len(at) else np.zeros(0, np.int64)
    return text[new], gram[new], np.diff(np.r_[new, len(text)])


def _counter(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(44)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a task's documents, in blocks."""
    total, docs, seen = np.zeros(COUNTERS, dtype=np.int64), 0, False
    for batch in slices(batches):
        _, gram, _ = shingles(batch.column("text"))
        total += np.bincount(_counter(gram), minlength=COUNTERS)
        docs, seen = docs + len(batch), True
    if seen:
        parts = total.astype("<i8").reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(np.r_[docs, np.zeros(BLOCKS - 1, np.int64)])],
            names=["block", "counts", "docs"],
        )


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, list] = {}
    for batch in batches:
        for block, counts, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            known = blocks.setdefault(block, [0, 0])
            known[0] = known[0] + np.frombuffer(counts, "<i8")
            known[1] += docs
    if blocks:
        rows = [(b, c.tobytes(), n) for b, (c, n) in blocks.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["block", "counts", "docs"])


def frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each counter: `COUNTERS` numbers of 4 bytes, whatever the number of documents."""
    kind = "block int, counts binary, docs long"
    rows = docs.select(text_of().alias("text")).mapInArrow(_count, kind).repartition("block").mapInArrow(_total, kind)
    counts, n = np.zeros((BLOCKS, COUNTERS // BLOCKS), dtype=np.int64), 0
    for r in rows.toLocalIterator():
        counts[r.block] = np.frombuffer(r.counts, "<i8")
        n += r.docs
    return idf(counts.ravel(), n)


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    mean = counts.mean()
    stands_out = counts > mean + 4 * np.sqrt(mean) + 4
    df = np.where(stands_out, np.minimum(counts - mean, n), 1)
    return (1 + DAMPING * np.log((n + 1) / (df + 1)) / np.log(n + 2)).astype(np.float32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Values of a Gamma(2, 1) variable at the middles of 65536 equal parts of its probability, and their logs."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = -np.expm1(-x) - x * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_GAMMA, _LOG_GAMMA = _tables()
_SEEDS = words.mix(np.arange(1, BANDS * ROWS + FINE_BANDS * FINE_ROWS + 1, dtype=np.uint64) * np.uint64(words.BASE))


def samples(text: np.ndarray, gram: np.ndarray, weight: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and their samples (text, sample), one per seed."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(text)])
    out = np.zeros((len(first), len(seeds)), dtype=np.uint64)
    if not len(first):
        return text, out
    log_weight = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    for k, seed in enumerate(seeds):
        u = (gram ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        u ^= u >> np.uint64(29)
        u *= np.uint64(0x94D049BB133111EB)
        r = _GAMMA[(u >> np.uint64(48)).astype(np.int64)]
        log_c = _LOG_GAMMA[((u >> np.uint64(32)) & low).astype(np.int64)]
        beta = ((u >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight / r + beta)
        score = log_c - r * (t - beta + 1)
        least = np.minimum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(least, size))
        owner = text[hit]
        hit = hit[np.r_[True, owner[1:] != owner[:-1]]]
        out[:, k] = words.mix(gram[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(words.BASE))
    return text[first], out


def band_keys(drawn: np.ndarray, rows: int) -> np.ndarray:
    """Key of each band of `rows` samples (text, band); equal in two texts where all samples of the band are."""
    bands = drawn.shape[1] // rows
    keys = np.zeros((len(drawn), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(drawn), b + 1, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = words.join_hash(key, drawn[:, k])
        keys[:, b] = key
    return keys


def _sign(table, seeds: np.ndarray, rows: int, sketch: bool = False):
    """Band keys of each text, and a bit of each sample, in place of the text; null where it has no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, gram, count = shingles(batch.column("text"))
            some, drawn = samples(text, gram, count * table.value[_counter(gram)], seeds)
            bands: list = [None] * len(batch)
            for i, k in zip(some.tolist(), band_keys(drawn, rows).view(np.int64).tolist(), strict=True):
                bands[i] = k
            kept = [c for c in batch.schema.names if c != "text"]
            columns, names = [pa.array(bands, pa.list_(pa.int64()))], [*kept, "bands"]
            if sketch:
                bits: list = [None] * len(batch)
                words_of = np.packbits((drawn[:, : SKETCH * 64] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                for i, k in zip(some.tolist(), words_of.tolist(), strict=True):
                    bits[i] = k
                columns.append(pa.array(bits, pa.list_(pa.int64())))
                names.append("sketch")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=names)

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text."""
    for batch in slices(batches):
        text, gram, _ = shingles(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(text)), pa.array(gram.view(np.int64))], names=["v", "gram"])


def outline(texts: pa.Array, alone: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: total weight, weight of the shingles in `alone`, and parity bits of its other shingles as 64-bit words."""
    text, gram, count = shingles(texts)
    weight = count * table[_counter(gram)].astype(float)
    sizes = pc.fill_null(pc.list_value_length(alone), 0).to_numpy(zero_copy_only=False)
    row = np.r_[text, np.repeat(np.arange(len(texts)), sizes)]
    both = np.r_[gram, pc.list_flatten(alone).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
    order = np.lexsort((both, row))  # stable: a text's shingle comes before its entry in the list
    row, both = row[order], both[order]
    own = np.zeros(len(order), dtype=bool)
    own[order[:-1][(row[1:] == row[:-1]) & (both[1:] == both[:-1])]] = True
    own = own[: len(text)]
    n, bits = len(texts), 64 * PARITY
    place = text * bits + (gram & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(place[~own & (count % 2 == 1)], minlength=n * bits) & 1
    words_of = np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)
    return np.bincount(text, weight, minlength=n), np.bincount(text[own], weight[own], minlength=n), words_of


def _outline(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, alone, parity = outline(batch.column("text"), batch.column("alone"), table.value)
            columns = [batch.column("v"), pa.array(total), pa.array(alone), pa.array(parity.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["v", "total", "alone", "parity"])

    return run


def similarities(a: pa.Array, b: pa.Array, table: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 where neither has a shingle."""
    parts = [shingles(x) for x in (a, b)]
    row = np.concatenate([p[0] for p in parts])
    gram = np.concatenate([p[1] for p in parts])
    weight = np.concatenate([p[2] * table[_counter(p[1])].astype(float) for p in parts])
    total = np.bincount(row, weight, minlength=len(a))
    order = np.lexsort((gram, row))
    row, gram, weight = row[order], gram[order], weight[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (gram[1:] == gram[:-1]))
    common = np.bincount(row[both], np.minimum(weight[both], weight[both + 1]), minlength=len(a))
    return np.where(total > 0, common / np.maximum(total - common, 1e-300), 0.0)


def _compare(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b", 1 << 19):
            j = similarities(batch.column("text_a"), batch.column("text_b"), table.value)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], names=["a", "b", "j"])

    return run


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(v, c) for every node of `links` (a, b): the least node of its component.

    Each step takes the least label among neighbours and then the label of that label, so labels travel ever farther.
    """
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u")))
    labels = scratch.stage(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("d")), "u").groupBy("v").agg(F.min("d").alias("d"))
        found = labels.join(near, "v").select("v", "c", F.least("c", "d").alias("d"))
        jump = labels.select(F.col("v").alias("d"), F.col("c").alias("e"))
        found = found.join(jump, "d", "left").select("v", "c", F.least("d", F.coalesce("e", "d")).alias("d"))
        found = scratch.stage(found, f"{name}-{step}")
        changed = not found.where("c != d").isEmpty()
        labels = found.select("v", F.col("d").alias("c"))
        scratch.drop(f"{name}-{step - 1}")
        if not changed:
            return labels


def signatures(spark: SparkSession, docs: DataFrame, scratch: Scratch, table) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, row, sha, v), `v` being the first row with an equal text, and (key, v) of shared bands."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    signed = scratch.stage(rows.mapInArrow(_sign(table, _SEEDS[: BANDS * ROWS], ROWS), "doc_id long, row long, sha binary, bands array<long>"), "signed")
    nodes = signed.groupBy("sha").agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("copies"))
    members = scratch.stage(signed.select("doc_id", "row", "sha").join(nodes, "sha"), "members")
    bands = signed.join(members.where("copies > 1 and row != v").select("row"), "row", "left_anti").select(F.col("row").alias("v"), F.explode("bands").alias("key"))
    return members, scratch.stage(_shared(bands), "bands")


def _texts(docs: DataFrame, members: DataFrame, bands: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, text) of all candidates."""
    wanted = members.where("row = v").join(bands.select("v").distinct(), "v").select(F.col("sha").alias("_sha"), "v")
    wanted = scratch.stage(wanted, "wanted")
    texts = docs.select(text_of().alias("text")).withColumn("_sha", F.unhex(F.sha2("text", 256)))
    # candidates grow with the documents: the same join at every size
    return scratch.stage(texts.join(wanted.hint("merge"), "_sha").groupBy("v").agg(F.first("text").alias("text")), "texts")


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows (key, v) those whose key has more than one, with the number of texts that v meets in all its keys.

    A text that others are copies of meets more texts than the copies do, so leaders are taken in this order.
    """
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(keys, "key").groupBy("v").agg(F.sum("n").alias("met"))
    return rows.join(keys.select("key"), "key").join(met, "v").select("key", "v", "met")


def _near_enough(least: float):
    """Whether sketches leave room for a similarity of `least`: bits agree with a probability of (1 + similarity) / 2."""
    n, p = 64 * SKETCH, (1 - least) / 2
    most = n * p + SIGMAS * np.sqrt(n * p * (1 - p))
    return _bits_apart("sketch", SKETCH) <= F.lit(float(most))


def _bits_apart(column: str, size: int) -> Column:
    return sum((F.bit_count(F.col(column)[i].bitwiseXOR(F.col(f"{column}_b")[i])) for i in range(size)), F.lit(0))


def _may_link(least: float, lightest: float):
    """Whether outlines let the similarity be `least`: of total weights S it is (S - x) / (S + x), x being the weight of the differences.

    No shingle weighs less than `lightest`.
    """
    differences = F.col("alone") + F.col("alone_b") + lightest * _bits_apart("parity", PARITY)
    return differences <= (F.col("total") + F.col("total_b")) * ((1 - least) / (1 + least) + 1e-9)


def _unlike(rows: DataFrame) -> DataFrame:
    """Rows (key, v, c) of keys that hold more than one class."""
    keys = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("key")
    return rows.join(keys, "key")


class _Search:
    """Classes found so far, and the comparisons that extend them."""

    def __init__(self, scratch: Scratch, texts: DataFrame, table, least: float):
        self.scratch, self.texts, self.table, self.least = scratch, texts, table, least
        self.classes: DataFrame | None = None
        self.turn = 0

    def classed(self, rows: DataFrame, node: str = "v", label: str = "c") -> DataFrame:
        if self.classes is None:
            return rows.withColumn(label, F.col(node))
        known = self.classes.select(F.col("v").alias(node), F.col("c").alias("_c"))
        return rows.join(known, node, "left").withColumn(label, F.coalesce("_c", node)).drop("_c")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Similarities (a, b, j) of pairs (v, b), a the lesser; links among them join classes."""
        self.turn += 1
        pairs = pairs.select(F.least("v", "b").alias("a"), F.greatest("v", "b").alias("b")).distinct()
        side = [self.texts.select(F.col("v").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
        rows = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "text_a", "text_b")
        tested = self.scratch.stage(rows.mapInArrow(_compare(self.table), "a long, b long, j double"), f"tested-{self.turn}")
        linked = tested.where(F.col("j") >= self.least).select("a", "b")
        if not linked.isEmpty():
            if self.classes is not None:  # each known class stands for the links that made it
                linked = linked.unionByName(self.classes.where("v != c").select(F.col("c").alias("a"), F.col("v").alias("b")))
            self.classes = components(self.scratch, linked, f"classes-{self.turn}")
        return tested

    def first_round(self, bands: DataFrame) -> DataFrame:
        """Compare each band with its leader; the nodes (v) that are open after that."""
        pairs = bands.join(bands.groupBy("key").agg(F.max(F.struct("met", "v"))["v"].alias("b")), "key").where("v != b")
        tested = self.compare(pairs)
        far = tested.select(F.col("a").alias("b"), F.col("b").alias("v"), (1 - F.col("j")).alias("x"))
        far = far.unionByName(tested.select("b", F.col("a").alias("v"), (1 - F.col("j")).alias("x")))
        rest = self.classed(self.classed(pairs.join(far, ["b", "v"]), "b", "c_b"))
        outside = rest.where("c != c_b").groupBy("key").agg(F.min("x").alias("nearest"))
        reach = F.col("x") >= F.col("nearest") - (1 - self.least) - 1e-9
        rest = rest.join(outside, "key").where((F.col("c") != F.col("c_b")) | reach)
        return self.scratch.stage(_unlike(rest.select("key", "v", "c")).select("v").distinct(), "open")

    def outlines(self, nodes: DataFrame) -> DataFrame:
        """(v, total, alone, parity) of the texts of `nodes`; shingles that only one of these texts has are alone."""
        texts = self.scratch.stage(self.texts.join(nodes, "v"), "crowd")
        grams = texts.mapInArrow(_grams, "v long, gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        alone = grams.where("n = 1").groupBy("v").agg(F.collect_list("gram").alias("alone"))
        texts = texts.join(alone, "v", "left").select("v", "text", "alone")
        return self.scratch.stage(texts.mapInArrow(_outline(self.table), "v long, total double, alone double, parity array<long>"), "outlines")

    def rounds(self, bands: DataFrame, sketches: DataFrame) -> None:
        """Compare ever more leaders of each band with texts of other classes, until no band is open."""
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("met"), "v"))
        rows = _unlike(self.classed(bands)).withColumn("place", place).join(sketches, "v")
        last, most, near = 1, 1, _near_enough(self.least)
        rows = self.scratch.stage(rows, "fine-0")
        while not rows.isEmpty():
            if most > LEADERS and "parity" not in rows.columns:
                rows = self.scratch.stage(rows.join(self.outlines(rows.select("v").distinct()), "v"), "fine-outlined")
                near = near & _may_link(self.least, float(self.table.value.min()))
            lead = rows.where(f"place <= {last}")
            lead = lead.select([F.col(n).alias("b" if n == "v" else f"{n}_b") for n in lead.columns if n not in ("met", "place")])
            unlike = (F.col("key") == F.col("key_b")) & (F.col("v") != F.col("b")) & (F.col("c") != F.col("c_b"))
            self.compare(rows.join(lead, unlike & near).select("v", "b"))
            rest = rows.where(f"place > {last}").drop("c")
            rows = self.scratch.stage(_unlike(self.classed(rest)), f"fine-{self.turn}")
            most *= LEADERS if most < LEADERS else LEADERS**2
            last += most


def links(spark: SparkSession, docs: DataFrame, bands: DataFrame, members: DataFrame, scratch: Scratch, table, least: float = LEAST) -> DataFrame | None:
    """(v, c) of nodes in classes of several texts; None where no two texts are linked."""
    if bands.isEmpty():
        return None
    texts = _texts(docs, members, bands, scratch)
    search = _Search(scratch, texts, table, least)
    still = search.first_round(bands)
    if not still.isEmpty():
        sign = _sign(table, _SEEDS[BANDS * ROWS :], FINE_ROWS, sketch=True)
        fine = texts.join(still, "v").select("v", "text").mapInArrow(sign, "v long, bands array<long>, sketch array<long>")
        fine = scratch.stage(fine, "fine-signed")
        bands = _shared(fine.select("v", F.explode("bands").alias("key")))
        search.rounds(bands, fine.select("v", "sketch"))
    return search.classes


def classes(spark: SparkSession, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, text_sha256.

    `class_id` is the smallest document id of the class, `class_size` its documents, copies included; one document
    of each class is kept, that with the smallest id, null ids last. Texts with fewer than five words have no
    shingle and are in one class only with equal texts; null counts as empty. Other columns are not read. An
    empty table gives no rows.
    """
    scratch = Scratch(spark, "near")
    table = spark.sparkContext.broadcast(frequencies(docs))
    members, bands = signatures(spark, docs, scratch, table)
    found = links(spark, docs, bands, members, scratch, table, least)
    if found is None:
        rows = members.withColumn("c", F.col("v"))
    else:
        rows = members.join(found, "v", "left").withColumn("c", F.coalesce("c", "v"))
    rows = scratch.stage(rows.select("doc_id", "row", "sha", "c"), "classed")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    by = rows.groupBy("c").agg(best, F.count(F.lit(1)).alias("class_size"))
    return rows.join(by, "c").select(
        "doc_id",
        F.col("best.doc_id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(spark: SparkSession, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each class, that with the smallest id, all columns unchanged, whatever their names.

    Null counts as the empty text; null ids go last; of rows that repeat id and text one stays. An empty table gives no rows.
    """
    scratch = Scratch(spark, "near-rows")
    decided = classes(spark, docs, least).where("class_size > 1").select("doc_id", F.unhex("text_sha256").alias("sha"), "kept")
    return keep_decided(scratch, docs, scratch.stage(decided, "decided"))
