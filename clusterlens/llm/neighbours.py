"""Approximate nearest neighbours by a forest of random-projection trees.

1. Equal vectors are one class with its six least ids: no answer of five can name more of them. A group of
   copies that holds a third of all rows is folded in map tasks.
2. Each tree is fitted on `SAMPLE` classes (those with the least hashes): a node projects on the difference of two
   random vectors of its own and splits at the median. All trees have the same depth, so the forest is a few megabytes
   at any table size. Every class is filed under one leaf of each tree. A leaf of more than `BLOCK_ROWS` lies in blocks
   by hash; a query that visits the leaf visits all of its blocks. Vectors of each length have a forest of their own.
3. A query searches all trees through one priority queue. The priority of a node is the sum of squared distances to the
   planes at which the way to it leaves the query's side; the nearest nodes of any tree are opened first until enough
   leaves are found. How many depends on the number of vectors only (`leaves_to_visit`): the share of a
   tree's leaves shrinks as that number to the power -0.2.
4. In a leaf the queries that visit it are compared with its vectors, block by block. The best are ranked again by
   the exact measure in double precision; the six best ids of each query and leaf meet in one aggregate.

Queries with equal vectors search once; each drops its own id from the six and keeps five.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm.shared import Scratch

TREES = 4
SAMPLE = 16_384
LEAST_SAMPLES = 16  # of the sample in a leaf
LEAST_ROWS = 32  # of the table in a leaf
VISITS = 80  # leaves a query visits in a large table
EFFORT = 6.0
BLOCK_ROWS = 8192
NEAREST = 5
EVERY = 50
SLACK = 1e-5


def share_to_visit(n: int) -> float:
    """Leaves that a query of n vectors visits, as a share of the leaves of one tree; at most all of all trees."""
    return min(float(TREES), EFFORT * max(n, 1) ** -0.2)


def leaves_per_tree(n: int) -> int:
    most = min(n / LEAST_ROWS, VISITS / share_to_visit(n), min(n, SAMPLE) / LEAST_SAMPLES)
    return 1 << max(0, int(math.log2(max(most, 1))))


def leaves_to_visit(n: int) -> int:
    return math.ceil(share_to_visit(n) * leaves_per_tree(n))


@dataclass
class Forest:
    """Trees of one depth in arrays: node k of a tree has the children 2k + 1 and 2k + 2."""

    normals: np.ndarray  # tree, node, component
    cuts: np.ndarray  # tree, node
    depth: int

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """Signed distance of each vector to the plane of each node: vector, tree, node."""
        flat = self.normals.reshape(-1, self.normals.shape[2])
        return (vectors @ flat.T - self.cuts.ravel()).reshape(len(vectors), *self.cuts.shape)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.cuts)), dtype=np.int64)
        if self.depth:
            side = self.margins(vectors) >= 0
            rows, trees = np.arange(len(vectors))[:, None], np.arange(len(self.cuts))[None]
            for _ in range(self.depth):
                out = 2 * out + 1 + side[rows, trees, out]
        return out - ((1 << self.depth) - 1)

    def search(self, margins: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the `visits` leaves nearest to a query, given its margins, over all trees at once."""
        first = (1 << self.depth) - 1
        queue = [(0.0, tree, 0) for tree in range(len(self.cuts))]
        found = []
        while queue and len(found) < visits:
            cost, tree, node = heapq.heappop(queue)
            while node < first:
                m = float(margins[tree, node])
                near = 2 * node + 1 + (m >= 0)
                heapq.heappush(queue, (cost + m * m, tree, 4 * node + 3 - near))
                node = near
            found.append((tree, node - first))
        return found


def grow(sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = 7) -> Forest:
    """A forest fitted on unit vectors."""
    rng = np.random.default_rng(seed)
    depth = leaves.bit_length() - 1
    normals = np.zeros((trees, leaves - 1, sample.shape[1]), dtype=np.float32)
    cuts = np.zeros((trees, leaves - 1), dtype=np.float32)
    for tree in range(trees):
        members = [np.arange(len(sample))]
        for node in range(leaves - 1):
            rows = members[node]
            pick = rows[rng.integers(len(rows), size=2)] if len(rows) else np.zeros(2, np.int64)
            normal = sample[pick[0]] - sample[pick[1]]
            if not normal.any():
                normal = rng.normal(size=len(normal)).astype(np.float32)
            normals[tree, node] = normal / np.linalg.norm(normal)
            at = sample[rows] @ normals[tree, node]
            cuts[tree, node] = np.median(at) if len(rows) else 0
            members += [rows[at < cuts[tree, node]], rows[at >= cuts[tree, node]]]
    return Forest(normals, cuts, depth)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision; the value of a pair does not depend on the rows around it."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _leaf_sizes(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, leaves = len(forest.cuts), 1 << forest.depth
        total = np.zeros((trees, leaves), dtype=np.int64)
        for batch in batches:
            if len(batch):
                leaf = forest.leaves(_unit(_matrix(batch.column("v"))))
                for tree in range(trees):
                    total[tree] += np.bincount(leaf[:, tree], minlength=leaves)
        tree, leaf = np.nonzero(total)
        columns = [tree.astype(np.int32), leaf.astype(np.int32), total[tree, leaf]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "leaf", "n"])

    return run


def _file(forest: Forest, blocks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            leaf = forest.leaves(_unit(_matrix(batch.column("v"))))
            hashes = batch.column("k1").to_numpy()
            for tree in range(leaf.shape[1]):
                block = hashes % blocks[tree, leaf[:, tree]]
                place = [np.full(len(batch), tree), leaf[:, tree], block]
                columns = [*(pa.array(c.astype(np.int32)) for c in place), batch.column("ids"), batch.column("v")]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "block", "ids", "v"])

    return run


def _visit(forest: Forest, visits: int, blocks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                margins = forest.margins(_unit(_matrix(part.column("v"))))
                found = [[(t, leaf, b) for t, leaf in forest.search(m, visits) for b in range(blocks[t, leaf])] for m in margins]
                take = pa.array(np.repeat(np.arange(len(part)), [len(f) for f in found]))
                places = np.array([x for f in found for x in f], dtype=np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(places[:, k].copy()) for k in range(3)), part.column("q").take(take), part.column("v").take(take)],
                    names=["tree", "leaf", "block", "q", "v"],
                )

    return run


def best_in_block(queries: np.ndarray, ids: list[list[int]], vectors: np.ndarray, most: int) -> Iterator[list[tuple[float, int]]]:
    """For each query the `most` nearest ids of a block as (score, id), nearest first, ties to the smaller id."""
    rough = _unit(queries) @ _unit(vectors).T
    kth = min(most, rough.shape[1]) - 1
    edge = -np.partition(-rough, kth, axis=1)[:, kth] - SLACK
    for q in range(len(queries)):
        near = np.flatnonzero(rough[q] >= edge[q])
        score = cosine(np.broadcast_to(queries[q], (len(near), queries.shape[1])), vectors[near])
        some = [(s, i) for s, k in zip(score.tolist(), near.tolist(), strict=True) for i in ids[k]]
        yield sorted(some, key=lambda x: (-x[0], x[1]))[:most]


def _compare(most: int):
    """Rows come block by block, vectors before queries: a block is held, its queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place, ids, vectors = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("tree", "leaf", "block")], axis=1)
            is_query = pa.compute.is_valid(batch.column("q")).to_numpy(zero_copy_only=False)
            change = np.any(key[1:] != key[:-1], axis=1) | (is_query[1:] != is_query[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), tuple(key[a].tolist())
                if not is_query[a]:
                    if here != place or vectors is not None:
                        held, vectors, place = [], None, here
                    held.append(part)
                    continue
                if here != place:  # a leaf without vectors
                    continue
                if vectors is None:
                    ids = [i for h in held for i in h.column("ids").to_pylist()]
                    vectors = np.concatenate([_matrix(h.column("v")) for h in held])
                    held = []
                for at in range(0, len(part), 512):
                    some = part.slice(at, 512)
                    found = list(best_in_block(_matrix(some.column("v")), ids, vectors, most))
                    q = some.column("q").take(pa.array(np.repeat(np.arange(len(some)), [len(f) for f in found])))
                    flat = [x for f in found for x in f]
                    yield pa.RecordBatch.from_arrays(
                        [q, pa.array([i for _, i in flat], pa.int64()), pa.array([s for s, _ in flat], pa.float64())], names=["q", "vec_id", "score"]
                    )

    return run


def _length_search(scratch: Scratch, classes: DataFrame, asked: DataFrame, size: int, n: int, most: int, forest_seed: int) -> DataFrame:
    """q, vec_id, score among the vectors of one length: what the leaves that each query visits hold."""
    sample = classes.orderBy("k1", "k2").limit(SAMPLE).select("v").toArrow()
    forest = grow(_unit(_matrix(sample.column("v").combine_chunks())), leaves_per_tree(n), seed=forest_seed)
    sizes = classes.select("v").mapInArrow(_leaf_sizes(forest), "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    blocks = np.ones((TREES, leaves_per_tree(n)), dtype=np.int64)
    for tree, leaf, held in sizes.collect():  # one row per leaf of the forest, whatever the table holds
        blocks[tree, leaf] = -(-held // BLOCK_ROWS)
    place = "tree int, leaf int, block int"
    filed = classes.select("k1", "ids", "v").mapInArrow(_file(forest, blocks), f"{place}, ids array<bigint>, v array<float>")
    visits = asked.select("q", "v").mapInArrow(_visit(forest, leaves_to_visit(n), blocks), f"{place}, q struct<k1:bigint,k2:bigint>, v array<float>")
    both = filed.withColumn("q", F.lit(None).cast("struct<k1:bigint,k2:bigint>")).unionByName(visits.withColumn("ids", F.lit(None).cast("array<bigint>")))
    met = both.repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", F.col("q").isNotNull())
    found = met.mapInArrow(_compare(most), "q struct<k1:bigint,k2:bigint>, vec_id long, score double")
    return scratch.stage(found, f"found-{size}")


def search(spark: SparkSession, table: DataFrame, nearest: int = NEAREST, every: int = EVERY, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its nearest found rows by cosine.

    Nearest first, ties to the smaller vec_id; fewer rows where there are fewer candidates. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do rows without a vec_id. Only vectors of equal length
    are compared. Rows repeated with id and vector count once. Rows that share the query's id are its own and no
    candidates; where one id has several vectors, each is asked for itself. Components are 32-bit floats. Other columns are not read; an empty table
    gives no rows. Vectors count as equal if 128 bits of their hashes agree; scores are of the vectors themselves.
    """
    scratch = Scratch(spark, "neighbours")
    v = F.col("embedding").cast("array<float>")
    sound = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = table.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(1), v).alias("k2"))
    most = nearest + 1
    members = rows.select("k1", "k2", "vec_id").distinct()
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    members = members.withColumn("n", place).where(F.col("n") <= most)
    members = members.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asks = F.col("vec_id") % every == 0
    one = rows.groupBy("k1", "k2").agg(F.any_value("v").alias("v"), F.bool_or(asks).alias("asked"))
    classes = scratch.stage(one.withColumn("size", F.size("v")).join(members, ["k1", "k2"]), "classes")
    asks = rows.where(asks)
    asked = classes.where("asked").select(F.struct("k1", "k2").alias("q"), "v", "size")
    found = None
    for size, n in sorted(classes.groupBy("size").count().collect()):
        of_size = F.col("size") == size
        some = _length_search(scratch, classes.where(of_size), asked.where(of_size), size, n, most, seed)
        found = some if found is None else found.unionByName(some)
    empty = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return spark.createDataFrame([], empty)
    # an id found in several trees once; the six best of each class of queries
    once = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = once.withColumn("n", place).where(F.col("n") <= most)
    best = best.groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")).alias("best"))
    best = scratch.stage(best.select(F.col("q.k1").alias("k1"), F.col("q.k2").alias("k2"), F.sort_array("best").alias("best")), "best")
    who = asks.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct().join(best, ["k1", "k2"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    out = who.select("query_id", F.posexplode(others).alias("at", "row"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.vec_id").alias("vec_id"), (-F.col("row.far")).alias("score"))
