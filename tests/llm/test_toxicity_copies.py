"""Copies among the labels must not push abusive words out of the vocabulary."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltmill.llm import toxicity

ABUSE = [f"vile{i}" for i in range(10)]


@pytest.mark.parametrize("near", [False, True])
def test_a_group_of_copies_hides_no_word(spark, near):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(3000)]
    table = []
    for i in range(600):
        words = rng.sample(plain, 60)
        toxic = i % 6 == 0
        table.append((i, " ".join(words + (rng.sample(ABUSE, 4) if toxic else [])), int(toxic)))
    # A third of all labels: one toxic text of 800 words and no abuse; near copies have one more word each.
    copied = [f"long{i}" for i in range(800)]
    table += [(1000 + i, " ".join(copied + [f"extra{i}"] * near), 1) for i in range(300)]
    frame = spark.createDataFrame(table, "doc_id long, text string, toxic int").withColumn("quality", F.lit(1) - F.col("toxic"))
    chain = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic"))
    assert set(ABUSE) <= set(chain.vocabulary)
    calls = [(chain.odds(text)[1] > 0) == bool(toxic) for i, text, toxic in table if i < 600]
    assert sum(calls) >= 0.97 * len(calls)
