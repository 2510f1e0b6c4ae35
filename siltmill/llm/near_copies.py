"""Near-copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash's ball hashing first: each shingle set has a 64-bit fingerprint, and fingerprints at up
to RADIUS = 3 differing bits meet as in ``simhash``. That can't reach every pair: at Jaccard 0.8 some 10 of 64 bits
differ, and balls of half that radius have millions of variants. What it leaves is added by MinHash: BANDS band
keys of ROWS minima each; a pair at exactly 0.8 shares none of them with probability (1 - 0.8**ROWS)**BANDS = 5e-6,
a nearer one with less. Meeting decides nothing: every link is verified on the two texts' whole shingle sets.

Texts with equal shingle sets are reduced to one node first. Nodes that share a key are tied to the smallest one
of the key, those of one fingerprint to the smallest one of it, and these as ball hashing links the fingerprints; the
components of these unverified ties hold every verified one. The texts of a component of two or more nodes (no
others) meet in one task. There a text is compared with those that share a key with it or are within RADIUS bits
(then one of four quarters of the fingerprint is equal), unless a link has joined them already, so a large group of
near-copies costs about one comparison a text. A task's memory is that of the shingle sets of the largest component,
8 bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, texts_of, written
from .simhash import RADIUS, components, fingerprint_of, kept_rows, near_links, text_sha

WIDTH = 5
LEAST_JACCARD = 0.8
BANDS, ROWS = 40, 6
SEED = 42
_RANDOM = np.random.default_rng(SEED)
#: h -> h * odd + any modulo 2**32, a permutation for each minimum.
_TIMES = (_RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer than WIDTH words is one shingle."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = min(WIDTH, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))), np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """BANDS signed 64-bit keys of a set; none for an empty set."""
    import xxhash

    if not len(own):
        return []
    h = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4_096):
        least = np.minimum(least, (h[None, i : i + 4_096] * _TIMES + _PLUS).min(axis=1))
    data = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(data)], np.uint64)
    return keys.view(np.int64).tolist()


def quarters(fp: int) -> list[tuple[int, int]]:
    """Keys of which fingerprints within RADIUS = 3 bits share one at least."""
    return [(i, fp >> 16 * i & 0xFFFF) for i in range(RADIUS + 1)]


def node_of(own: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted distinct arrays; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


class _Group:
    """The nodes of one candidate component, linked as they come."""

    def __init__(self):
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.fps: list[int] = []
        self.parent: list[int] = []
        #: For each band key and quarter the nodes that have it, by the root they had when last looked at.
        self.by_key: dict[int | tuple[int, int], dict[int, list[int]]] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, node: int, text: str | None) -> None:
        own = shingles(text)
        x = len(self.nodes)
        self.nodes.append(node)
        self.sets.append(own)
        self.fps.append(fingerprint_of(own))
        self.parent.append(x)
        done: set[int] = set()
        for key in [*quarters(self.fps[x]), *band_keys(own)]:
            by_bits = isinstance(key, tuple)
            found = self.by_key.setdefault(key, {})
            for r in list(found):
                now = self.root(r)
                if now != r:
                    stale = found.pop(r)
                    into = found.setdefault(now, [])
                    small, large = sorted((stale, into), key=len)
                    large.extend(small)
                    found[now] = large
            for r, members in found.items():
                if self.root(r) == self.root(x):
                    continue
                for m in members:
                    if m in done or by_bits and (self.fps[m] ^ self.fps[x]).bit_count() > RADIUS:
                        continue
                    done.add(m)
                    if self.near(m, x):
                        a, b = self.root(m), self.root(x)
                        self.parent[max(a, b)] = min(a, b)
                        break
            found.setdefault(x, []).append(x)

    def near(self, x: int, y: int) -> bool:
        a, b = self.sets[x], self.sets[y]
        if min(len(a), len(b)) < LEAST_JACCARD * max(len(a), len(b)):
            return False
        return jaccard(a, b) >= LEAST_JACCARD

    def rows(self) -> pa.RecordBatch:
        roots = [self.nodes[self.root(x)] for x in range(len(self.nodes))]
        return pa.RecordBatch.from_arrays([pa.array(self.nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(candidate, node, text) sorted by candidate -> (node, root)."""
    group, last = _Group(), None
    for batch in batches:
        for candidate, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if candidate != last:
                if group.nodes:
                    yield group.rows()
                group, last = _Group(), candidate
            group.add(node, text)
    if group.nodes:
        yield group.rows()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-copies: the one with the smallest doc_id (rows without one
    come last). A group is a component of the links at LEAST_JACCARD or more; all texts without words are one group.

    All columns stay. Of rows that repeat both doc_id and text one stays.
    """

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "sha": batch.column(2), "node": [node_of(s) for s in sets], "fp": np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64), "keys": [band_keys(s) for s in sets]}

        return each

    rows = texts_of(docs, id_col, text_col).withColumn("sha", text_sha("text"))
    marked = written(map_batches(rows, make, "doc_id long, sha string, node long, fp long, keys array<long>"))
    # The smallest (doc_id, sha) of each shingle set, then of each group.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("sha").alias("sha")))
    distinct = written(marked.groupBy("node").agg(first.alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    # Ball hashing: fingerprints' links, between the smallest node of each, to which the others of the fingerprint are tied.
    by_fp = written(distinct.groupBy("fp").agg(F.min("node").alias("least")))
    side = lambda fp, node: by_fp.select(F.col("fp").alias(fp), F.col("least").alias(node))
    met = near_links(by_fp.select("fp")).toDF("x", "y").join(side("x", "a"), "x").join(side("y", "b"), "y").select("a", "b")
    same = distinct.select("fp", "node").join(by_fp, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    by_key = Window.partitionBy("key").orderBy("node")
    ties = distinct.select("node", F.explode("keys").alias("key")).withColumn("least", F.first("node").over(by_key))
    banded = ties.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    tied = components(met.unionByName(same).unionByName(banded))
    candidates = written(tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "candidate"))
    wanted = candidates.join(distinct.select("node", "first"), "node").select("candidate", "node", F.col("first.id").alias("__id"), F.col("first.sha").alias("__sha"))
    texts = kept_rows(docs, wanted, id_col, text_col).select("candidate", "node", F.col("__row")[text_col].cast("string").alias("text"))
    checked = texts.repartition("candidate").sortWithinPartitions("candidate").mapInArrow(_verified, "node long, root long")
    rooted = distinct.select("node", "first").join(written(checked), "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__id"), F.col("first.sha").alias("__sha"))
    return kept_rows(docs, keep, id_col, text_col).select("__row.*")
