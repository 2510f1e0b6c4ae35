"""Tokenising and BM25 as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not indexed.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")
MIN_LENGTH = 2
K1, B = 1.2, 0.75


def tokenize(column: Column | str) -> Column:
    """Terms of a text in order, repeats included; null and empty texts have none."""
    c = F.col(column) if isinstance(column, str) else column
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) >= MIN_LENGTH) & ~t.isin(*STOPWORDS))
    return F.coalesce(kept, F.array().cast("array<string>"))


def query_terms(query: str) -> list[str]:
    """The terms of a query, as ``tokenize`` gives them for its text."""
    return [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) >= MIN_LENGTH and t not in STOPWORDS]


def analyze(fields: Sequence[str]) -> Column:
    """Terms of several fields one after the other; no term spans two fields."""
    return F.concat(*[tokenize(f) for f in fields])


def check_bm25(k1: float, b: float) -> None:
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError(f"k1 must be at least 0 and b within 0 and 1, not {k1} and {b}")


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def term_score(tf: Column, length: Column, average: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """BM25 of one term in one document; without an average length, lengths don't matter."""
    norm = F.when(average > 0, 1 - b + b * length / average).otherwise(1.0)
    return F.when(tf > 0, weight * tf * (k1 + 1) / (tf + k1 * norm)).otherwise(0.0)


def delta_encode(ids: Column) -> Column:
    """The first value and then the gaps of an ascending array."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1)))


def delta_decode(gaps: Column) -> Column:
    return F.transform(gaps, lambda x, i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y))


def bit_width(largest: Column) -> Column:
    """Bits that a block of values needs; at least one."""
    return F.greatest(F.lit(1), F.length(F.bin(largest)))
