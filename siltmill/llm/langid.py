"""Language identification by rank-order profiles.

A profile is the list of the most frequent byte n-grams (1 to 3 bytes of the lower-cased letters, words set
apart by spaces), in order of frequency. A document's language is the one whose profile is nearest to its own
by the out-of-place distance: the sum, over the document's n-grams, of how far each stands from its place in
the language's profile, or the whole length of a profile for those that are not in it.

Profiles are counted over every training document. They are the only thing that goes to the driver: PROFILE
n-grams for each of at most MAX_LANGUAGES languages.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

#: N-grams of a language's profile and of a document's.
PROFILE = 400
#: More distinct language values than this are an error: the profiles would no longer be small.
MAX_LANGUAGES = 1_000
#: Texts that score below this are far from every profile: random letters, hex dumps, base64 and languages that were
#: not learned score 0.09 to 0.24 here, real English against profiles of invented English 0.39, and of 6,000 documents
#: none less than 0.39.
REJECT_SCORE = 0.3
UNKNOWN = "und"
#: Bytes of text whose n-grams are counted at a time, so that a very long text takes no more memory than some times this.
CHUNK = 4_000_000

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> np.ndarray:
    """The bytes that n-grams are taken from: lower-cased letters, single spaces for all else and at both ends."""
    return np.frombuffer(f" {_NOT_LETTERS.sub(' ', text).strip().lower()} ".encode(), np.uint8)


class Counts:
    """Counts of n-grams (length << 24 | bytes), CHUNK bytes of text in the making at a time."""

    def __init__(self):
        self.ids, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> Counts:
        data = letters(text)
        for lo in range(0, len(data), CHUNK):
            # Every n-gram counts in the chunk that it begins in.
            b = data[lo : lo + CHUNK + 2].astype(np.int32)
            pairs = b[:-1] << 8 | b[1:]
            triples = pairs[:-1] << 8 | b[2:]
            self.held += [b[:CHUNK] | 1 << 24, pairs[:CHUNK] | 2 << 24, triples[:CHUNK] | 3 << 24]
            self.size += min(CHUNK, len(b))
            if self.size >= CHUNK:
                self._settle()
        return self

    def _settle(self) -> None:
        ids, n = _distinct(np.concatenate(self.held))
        self.held, self.size = [], 0
        if not len(self.ids):
            self.ids, self.n = ids, n
            return
        self.ids, at = np.unique(np.concatenate([self.ids, ids]), return_inverse=True)
        self.n = np.bincount(at, weights=np.concatenate([self.n, n])).astype(np.int64)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and their counts, without the lone space, which says nothing."""
        if self.held:
            self._settle()
        keep = self.ids != (1 << 24 | 32)
        return self.ids[keep], self.n[keep]


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.sort(ids)
    edge = np.nonzero(np.append(True, ids[1:] != ids[:-1]))[0]
    return ids[edge], np.diff(np.append(edge, len(ids)))


def ranked(ids: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by n-gram."""
    return ids[np.lexsort((ids, -n))[:size]]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, from all rows with a language and a text that has a letter."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            by: dict[str, Counts] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    by.setdefault(lang, Counts()).add(text)
            langs, ids, n = [], [], []
            for lang, counts in by.items():
                i, c = counts.result()
                langs += [lang] * len(i)
                ids.append(i)
                n.append(c)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return {"lang": langs, "gram": cat(ids).astype(np.int32), "n": cat(n).astype(np.int64)}

        return each

    n = map_batches(rows, make, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= size)
    found = top.select("lang", "gram", "place").orderBy("lang", "place").limit(size * MAX_LANGUAGES + 1).collect()
    if len(found) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list[int]] = {}
    for lang, gram, _ in found:
        profiles.setdefault(lang, []).append(gram)
    return profiles


class Predictor:
    """Compares texts with profiles; ties go to the language that sorts first."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.known = np.array(sorted({g for p in profiles.values() for g in p}), np.int32)
        self.places = np.full((len(self.known) + 1, len(self.langs)), -1, np.int32)
        for j, lang in enumerate(self.langs):
            self.places[np.searchsorted(self.known, np.array(profiles[lang], np.int32)), j] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - distance / largest distance; (und, 0) for texts without letters."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        own = ranked(*Counts().add(text).result(), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        place = np.where((self.known[at] == own)[:, None], self.places[at], -1)
        out = np.where(place < 0, self.size, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(out))
        return self.langs[best], float(1 - out[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), held_out (crc32 of the doc_id as text is divisible by 5; null ids: false).

    Null and empty texts and texts without a letter are ``und`` with score 0, as is every text when nothing
    was learned. One row for each row; other columns are ignored.
    """

    def make():
        look = Predictor(profiles)

        def each(batch: pa.RecordBatch) -> dict:
            got = [look(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "held_out": [x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in batch.column(0).to_pylist()],
                "lang_pred": [g[0] for g in got],
                "score": [g[1] for g in got],
            }

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the doc_id as text is not divisible by 5."""
    return docs.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
