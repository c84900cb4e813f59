"""Rounds over open bands: rows are numbered once, and a round passes on only rows that have not led."""

import random

from pyspark.sql import functions as F

from clusterlens.llm import near_dedup


def test_rounds_number_the_rows_of_bands_once(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(60):
        words = list(base)
        for k in rng.sample(range(4, 296), 4):
            words[k] = f"x{rng.random()}"
        texts.append(" ".join(words))
    stage, plans, left = near_dedup.Scratch.stage, [], []

    def watched(self, df, name):
        out = stage(self, df, name)
        if name.startswith("fine-") and name[5:].isdigit():
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            left.append({(r.key, r.v): r.place for r in out.select("key", "v", "place" if "place" in out.columns else F.lit(0).alias("place")).collect()})
        return out

    monkeypatch.setattr(near_dedup.Scratch, "stage", watched)
    near_dedup.classes(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(plans) > 2
    assert not any("LeftAnti" in p or "Window" in p for p in plans[1:])
    for earlier, later in zip(left, left[1:]):
        assert later.items() <= earlier.items() and not any(place == 1 for place in later.values())
