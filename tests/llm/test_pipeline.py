"""The pipeline's stages against what each must keep."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from siltmill.llm import langid, toxicity


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "near_duplicates", "pii", "packing"]
    extra = spark.createDataFrame([(10_001, "12345 !!", "en", "s", 8), (10_002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())

    told = stages["language"](spark, docs, sf).cache()
    assert told.columns == docs.columns and told.schema == docs.schema
    assert set(ids(docs)) - set(ids(told)) >= {10_001, 10_002} and docs.count() - told.count() <= 4

    clean = stages["toxicity"](spark, told, sf).cache()
    chain = toxicity.train(told, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r["doc_id"] for r in told.collect() if chain.odds(r["text"])[1] <= 0}
    assert set(ids(clean)) == want and clean.columns == docs.columns

    single = stages["near_duplicates"](spark, clean, sf).cache()
    groups = plain_groups(clean.collect())
    assert set(ids(single)) == groups and max(ids(single).values()) == 1

    private = stages["pii"](spark, single, sf)
    for r in private.collect():
        assert not re.search(r"[\w.]+@\w+\.\w+", r["text"]) and r["n_chars"] == len(r["text"])

    packed = stages["packing"](spark, private, sf)
    assert set(ids(packed)) == groups
    assert langid.UNKNOWN == "und"


def plain_groups(rows) -> set[int]:
    """The smallest doc_id of each component of texts whose sets of five-word shingles have a Jaccard of 0.8 or more."""
    sets = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        n = min(5, len(words))
        sets.append({b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return set(least.values())


def test_run_on_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_keep_clashing_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ("__keep", "keep", "__p_toxic", "p_toxic", "redacted", "__redacted", "__own", "__row", "__id", "__sha", "node", "candidate", "root", "a.b")
    wide = docs.selectExpr("*", *[f"doc_id as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        rows = out.selectExpr("doc_id", *[f"`{n}`" for n in names]).collect()
        assert rows and all(set(r) == {r[0]} for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).count() >= docs.count()


def test_language_rejects_junk(spark):
    """Junk and languages that were not learned go, documents and real text in a learned language stay."""
    import random

    sf = "/root/testdata/sf0.01"
    r = random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = [
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(200)),
        "".join(r.choice("0123456789abcdef") for _ in range(2000)),
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "12345 67890 !!!",
    ]
    plain = "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another."
    extra = spark.createDataFrame([(10**6 + 5 * i, t, None, None, None) for i, t in enumerate([*junk, plain])], docs.schema)
    kept = {x[0] for x in stage_ids(spark, docs.unionByName(extra), sf)}
    assert not kept & {10**6 + 5 * i for i in range(len(junk))} and 10**6 + 5 * len(junk) in kept
    lettered = {x[0] for x in docs.collect() if x["text"] and any(map(str.isalpha, x["text"]))}
    assert len(lettered - kept) <= len(lettered) // 500


def stage_ids(spark, docs, sf):
    return dict(corpus_pipeline.STAGES)["language"](spark, docs, sf).select("doc_id").collect()
