"""Audit of how five document filters interact, in every order in which they can be applied.

A document fails
  A with fewer than 200 words, B where distinct words are fewer than half of its words, C where more than 3% of its
  code points are in A-Z, D where it holds one of `#$%&*|`, E where a smaller doc_id has the same text.

E is an existential self-join. One pass over the texts stores a narrow row per document (id, hashes, the bits of A to D).
Hashes under which two different ids occur name the candidates; only their texts are read again. The right side
of the join is the least id of each hash and exact text, folded in map tasks, so a group of copies is one row there; a
left-semi join on hash, exact text and smaller id marks E. A hash with many rows is salted: its one right row is
copied once per `SALT_ROWS` rows of the group and its left rows are dealt to the copies, so that no task gets a crowd.

The ids of E are then united with the other failure ids, the bits of each document combined by one aggregate, and
documents counted by part and bit combination: at most 32 rows a part. The 120 orders are laid over those counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm.shared import Scratch, text_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 3  # percent of the code points
MARKS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
SALT_ROWS = 2048
E_BIT = 1 << FILTERS.index("E")


def text_bits(text: Column) -> Column:
    """The failure bits of A to D of a text."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [
        n < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * n,
        100 * capitals > MOST_CAPITALS * F.length(text),
        text.rlike(MARKS),
    ]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def smaller_copies(scratch: Scratch, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, h, h2 of the documents whose text a smaller doc_id has, once each.

    `rows` is the stored table of (doc_id, h, h2). A null id is neither smaller nor larger than any.
    """
    crowds = rows.where("doc_id is not null").groupBy("h").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    crowds = crowds.where("lo < hi").select("h", F.ceil(F.col("n") / SALT_ROWS).alias("salts"))
    crowds = scratch.stage(crowds, "crowds")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text")).join(crowds, "h")
    salt = F.pmod(F.xxhash64("doc_id"), F.col("salts"))
    left = texts.select("doc_id", "h", "text", salt.alias("salt")).alias("l")
    first = texts.groupBy("h", "text").agg(F.min("doc_id").alias("least"), F.max("salts").alias("salts"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("h", "salt", "text")]
    later = left.join(first, [*same, F.col("r.least") < F.col("l.doc_id")], "left_semi")
    return later.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2")).distinct()


def bit_counts(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: documents of each language and combination of failures."""
    scratch = Scratch(spark, "audit")
    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        text_bits(text).alias("bits"),
    )
    rows = scratch.stage(rows, "rows")
    # one row per document of a part, however often it is listed; E has no part of its own and goes to each
    keys = ["doc_id", "h", "h2"]
    plain = rows.groupBy(*keys, "part", "bits").agg(F.count(F.lit(1)).alias("n"))
    copies = smaller_copies(scratch, docs, rows)
    one = F.struct("part", "bits", "n")
    failures = plain.select(*keys, one.alias("own"), F.lit(0).alias("bit")).unionByName(
        copies.select(*keys, F.lit(None).cast("struct<part:string,bits:int,n:bigint>").alias("own"), F.lit(E_BIT).alias("bit"))
    )
    judged = failures.groupBy(*keys).agg(F.collect_list("own").alias("own"), F.bit_or("bit").alias("bit"))
    judged = judged.select("doc_id", "bit", F.explode("own").alias("own")).select(
        "doc_id", F.col("own.part").alias("part"), F.col("own.bits").bitwiseOR(F.col("bit")).alias("bits"), F.col("own.n").alias("n")
    )
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = judged.join(known, "doc_id", "left").groupBy("part", "bits")
    amount = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic"))]
    return scratch.stage(counted.agg(*amount), "counts")


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A part is a language; null counts as the empty one. Null texts are empty. Rows repeated with id and text count each,
    and none of them is smaller than the other; rows with a null id fail E never and make no other row fail it. Of
    several labels of one id, one that says good (toxic) is enough; labels of null ids are not used. Other columns
    are not read. Without documents there are no rows. Two texts of one id count as the same document's only
    if 128 bits of hash agree; E itself compares texts.
    """
    counts = bit_counts(spark, docs, labels)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit_of = F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(FILTERS))),
        F.lit(0),
        lambda acc, k: acc + F.when(k < F.col("step"), F.element_at(bit_of, F.substring("filter_order", k, F.lit(1)))).otherwise(0),
    )
    steps = steps.select("*", letter.alias("letter"), F.element_at(bit_of, letter).alias("bit"), before.alias("before"))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(of))), F.lit(0)).cast("long")

    out = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")).cast("long")).drop("letter")
