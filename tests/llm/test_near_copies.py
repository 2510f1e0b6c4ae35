"""The pipeline's near-copies against all pairs, and on planted copies."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
from siltmill.llm import near_copies


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def smallest_of_groups(table):
    ids, sets = [i for i, _ in table], [five_words(t) for _, t in table]
    group = {i: i for i in ids}
    for (x, a), (y, b) in combinations(zip(ids, sets, strict=True), 2):
        if similarity(a, b) >= 0.8 and group[x] != group[y]:
            low, high = sorted((group[x], group[y]))
            group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())


def test_planted_near_copies_go(spark):
    rng = random.Random(7)
    table, seen = [], []
    for k in range(12):
        base = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice([60, 300, 1500]))]
        table.append((1000 + k, " ".join(base)))
        # Each changed word breaks five shingles; the last one falls below 0.8 and must stay.
        for n, share in enumerate((0.003, 0.01, 0.018, 0.05)):
            words = list(base)
            for at in range(3, len(words), max(10, int(1 / share))):
                words[at] = f"other{k}x{n}"
            table.append((2000 + 10 * k + n, " ".join(words)))
            seen.append(similarity(five_words(table[-1][1]), five_words(" ".join(base))))
    table += [(1, None), (2, ""), (3, "two words"), (4, "Two  WORDS"), (5, "two word")]
    assert sum(0.8 <= s < 1 for s in seen) >= 30 and min(s for s in seen if s >= 0.8) < 0.85 and sum(s < 0.8 for s in seen) >= 12
    docs = spark.createDataFrame(table, "doc_id long, text string")
    kept = [r[0] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()]
    assert sorted(kept) == sorted(smallest_of_groups(table))


def test_real_near_copies_go(spark, small):
    table = [(r["doc_id"], r["text"]) for r in small.collect()]
    out = near_copies.deduplicated(small)
    assert out.columns == small.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(smallest_of_groups(table))


def test_awkward_rows(spark, docs):
    kept = near_copies.deduplicated(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "3", "6", "7", "8", "9"])


def test_ball_hashing_finds_copies_by_itself(spark, monkeypatch):
    """Near fingerprints alone bring texts together; a pair within the radius is linked only if its texts are near."""
    from siltmill.llm import simhash

    rng = random.Random(3)
    table = []
    for k in range(12):
        base = [f"w{rng.randrange(50_000)}" for _ in range(1500)]
        table.append((100 + k, " ".join(base)))
        base[700] = "other"
        table.append((200 + k, " ".join(base)))
    fps = [simhash.fingerprint_of(near_copies.shingles(t)) for _, t in table]
    near = [(fps[2 * k] ^ fps[2 * k + 1]).bit_count() <= 3 for k in range(12)]
    assert sum(near) >= 8
    monkeypatch.setattr(near_copies, "band_keys", lambda own: [])
    docs = spark.createDataFrame(table, "doc_id long, text string")
    kept = {r[0] for r in near_copies.deduplicated(docs).select("doc_id").collect()}
    assert kept == {i for i, _ in table} - {200 + k for k in range(12) if near[k]}


def test_near_fingerprints_are_verified(monkeypatch):
    """Equal fingerprints link no far texts; fingerprints at three bits share a quarter."""
    monkeypatch.setattr(near_copies, "fingerprint_of", lambda own: 5)
    group = near_copies._Group()
    for node, text in enumerate(["one two three four five six", "nothing like it at all", None, "One two  three four five six"]):
        group.add(node, text)
    assert [group.root(x) for x in range(4)] == [0, 1, 2, 0]
    for fp in (0, 2**64 - 1, 12345):
        assert set(near_copies.quarters(fp)) & set(near_copies.quarters(fp ^ 1 << 3 ^ 1 << 17 ^ 1 << 60))
