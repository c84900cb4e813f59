"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit key from its id and text. Per source the budget is so many whole passes over the
source plus a rest; the rest is met by the documents whose key lies below a threshold. The threshold is found
without sorting: sizes are summed by the first 12 key bits, the one bucket in which the running sum crosses the
rest is summed again by the next 12 bits, and so on until it holds a single key. Thresholds are nested: with the
same seed a larger budget takes all a smaller one took. One filter over the documents then carries out the mix.

Sums are pre-aggregated in map tasks, at most 4096 rows per source and task, so a hot source costs no more than
any other. Shares of sources are worked out in one window over a table with one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm.shared import Scratch, text_of, whole_row

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
KEY_BITS = 60
LEVEL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def size_of(column: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def key_of(seed: str = "mix", id_column: str = "doc_id", text_column: str = "text") -> Column:
    parts = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")), text_of(text_column))
    return F.conv(F.substring(F.md5(parts), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: the budget dealt by weight, none above `most` times its source's size.

    What a full source cannot take goes to the others by weight, until none is above. Sources in code point
    order, null last, have the weights in turn. With f(x) = sum of least(most * size, weight * x), which only
    grows, the fair level x is where f meets the budget; sources are full in the order of size by weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    by = by.withColumn("weight", weight).withColumn("limit", limit)
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, before = fill.rowsBetween(Window.unboundedPreceding, 0), fill.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(float(share)) * F.sum("source_size").over(whole)
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / open_weight
    full = (F.col("limit") / F.col("weight")) <= F.col("level")
    by = by.withColumn("level", level).withColumn("full", full)
    by = by.withColumn("place", F.row_number().over(fill))
    # the first source that is not full has the fair level; all from there on share it
    fair = F.min_by(F.col("level"), F.when(~F.col("full"), F.col("place"))).over(whole)
    target = F.when(fair.isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * fair))
    return by.select("source", "source_size", target.alias("target"))


def thresholds(scratch: Scratch, keyed: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target, passes, cut: documents with key < cut are taken once more than `passes` times."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("passes", passes.cast("long"))
    goal = scratch.stage(goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    state = goal.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    found = None
    for level in range(KEY_BITS // LEVEL_BITS):
        shift = KEY_BITS - LEVEL_BITS * level
        inside = keyed["source"].eqNullSafe(state["s"])
        if level:
            inside = inside & (F.shiftright(keyed["key"], shift) == state["prefix"])
        bucket = F.shiftright("key", shift - LEVEL_BITS).alias("bucket")
        sums = (
            keyed.join(state.select("s", "prefix"), inside)
            .groupBy("s", bucket)
            .agg(F.sum("size").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        )
        sums = sums.join(state.select(F.col("s").alias("s2"), "rest", "below"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
        run = F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) + F.col("below")
        edge = sums.withColumn("upto", run).where("upto > rest and upto - n <= rest")
        edge = scratch.stage(edge.select("s", "rest", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("n")).alias("below"), "n", "low", "high"), f"edge{level}")
        last = level + 1 == KEY_BITS // LEVEL_BITS
        single = edge if last else edge.where("low = high")
        found = single if found is None else found.unionByName(single)
        state = edge.where("low < high")
        if last or state.isEmpty():
            break
    nearer = F.col("below") + F.col("n") - F.col("rest") < F.col("rest") - F.col("below")
    found = found.select(F.col("s"), F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("cut"))
    out = goal.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    return scratch.stage(out.select("source", "source_size", "target", "passes", F.coalesce("cut", F.lit(0)).alias("cut")), "thresholds")


def plan(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The stored sizes and keys (doc_id, source, size, key) and the thresholds of the mix."""
    scratch = Scratch(spark, "mix")
    keyed = scratch.stage(docs.select("doc_id", "source", size_of().alias("size"), key_of(seed).alias("key")), "keyed")
    return keyed, thresholds(scratch, keyed, targets(keyed, weights, share))


def _with_cut(rows: DataFrame, cuts: DataFrame, source: Column) -> DataFrame:
    cuts = cuts.select(*[F.col(c).alias(f"_cut_{c}") for c in cuts.columns])
    return rows.join(cuts, source.eqNullSafe(F.col("_cut_source")), "left")


def _times(key: Column) -> Column:
    return F.col("_cut_passes") + F.when(key < F.col("_cut_cut"), 1).otherwise(0)


def summary(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null texts have size 0 and null sources are a source. Rows equal in id and text share a key and are taken
    together. Other columns are not read. An empty table gives no rows.
    """
    keyed, cuts = plan(spark, docs, weights, share, seed)
    return _with_cut(keyed, cuts, F.col("source")).select(
        "doc_id",
        "size",
        F.col("_cut_source_size").alias("source_size"),
        F.col("_cut_target").alias("target"),
        (F.col("size") * _times(F.col("key"))).alias("taken"),
    )


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, seed: str = "mix") -> DataFrame:
    """The rows of the mix, all columns of `docs`, whatever their names, each as often as it is taken.

    Null texts have size 0 and are taken by their key like any other; null sources are a source. Rows equal in id and text
    are taken together. An empty table gives no rows.
    """
    _, cuts = plan(spark, docs, weights, share, seed)
    rows = whole_row(docs, source=F.col("source"), key=key_of(seed))
    rows = _with_cut(rows, cuts, F.col("source")).withColumn("times", _times(F.col("key")).cast("int")).where("times > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
