"""The inverted index as four tables.

* docs(segment, doc_id, length, ts, stored fields)
* postings(segment, term, doc_id, tf, length) - a posting carries its document's length, so scoring joins no documents
* termdict(segment, term, df)
* segments(segment, num_docs, num_terms, num_postings, total_length, min_ts, max_ts)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyze, delta_encode
from .sequence import with_sequence


TABLES = ("docs", "postings", "termdict", "segments")


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    termdict: DataFrame
    segments: DataFrame
    #: Of a stored index, the rows of ``segments`` by name; searches plan with them on the driver. None where the
    #: tables are plans of their own or have too many segments.
    stats: dict[str, dict] | None = None

    def cache(self) -> Index:
        return replace(self, **{k: getattr(self, k).cache() for k in TABLES})

    def only(self, names: Sequence[str]) -> Index:
        """The same index with some of its segments; of stored tables only their folders are read."""
        tables = {k: getattr(self, k).filter(F.col("segment").isin(*names)) for k in TABLES}
        return replace(self, **tables, stats=None if self.stats is None else {n: self.stats[n] for n in names})


def assign_segments(df: DataFrame, docs_per_segment: int, position: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Adds ``segment`` and the segment's own ``doc_id`` by arrival.

    ``position`` names a column that already counts arrivals (offsets, row numbers); else ``order`` is counted.
    """
    if docs_per_segment < 1:
        raise ValueError("docs_per_segment must be at least 1")
    if position is None:
        df, position = with_sequence(df, order, "__seq"), "__seq"
    place = F.col(position)
    out = df.withColumn("__segment", F.floor(place / docs_per_segment)).withColumn("__doc", F.pmod(place, F.lit(docs_per_segment)))
    return out.drop(*{"segment", "doc_id", "__seq"} & set(out.columns)).withColumnsRenamed({"__segment": "segment", "__doc": "doc_id"})


def build_postings(docs: DataFrame) -> DataFrame:
    """(segment, term, doc_id, tf, length) from docs with ``tokens``; counts are combined before the shuffle."""
    counted = docs.select("segment", "doc_id", "length", F.explode("tokens").alias("term"))
    return counted.groupBy("segment", "doc_id", "length", "term").agg(F.count("*").cast("int").alias("tf")).select("segment", "term", "doc_id", "tf", "length")


def analyzed(df: DataFrame, fields: Sequence[str], ts: Column | None = None) -> DataFrame:
    """Docs with ``tokens``, ``length`` and ``ts``; fields that are absent contribute nothing."""
    there = [f for f in fields if f in df.columns]
    tokens = analyze(there) if there else F.array().cast("array<string>")
    stamp = ts if ts is not None else F.col("ts").cast("long") if "ts" in df.columns else F.lit(None).cast("long")
    return df.withColumn("tokens", tokens).withColumn("length", F.size("tokens")).withColumn("ts", stamp)


def segment_stats(docs: DataFrame, termdict: DataFrame) -> DataFrame:
    """One row for each segment; documents without terms count, min and max ts are 0 if there is none."""
    of_docs = docs.groupBy("segment").agg(
        F.count("*").alias("num_docs"), F.sum(F.col("length").cast("long")).alias("total_length"),
        F.coalesce(F.min("ts"), F.lit(0)).cast("long").alias("min_ts"), F.coalesce(F.max("ts"), F.lit(0)).cast("long").alias("max_ts"),
    )
    of_terms = termdict.groupBy("segment").agg(F.count("*").alias("num_terms"), F.sum("df").alias("num_postings"))
    zero = {"num_terms": 0, "num_postings": 0}
    return of_docs.join(of_terms, "segment", "left").fillna(zero).select("segment", "num_docs", "num_terms", "num_postings", "total_length", "min_ts", "max_ts")


def build_index(df: DataFrame, fields: Sequence[str], docs_per_segment: int, position: str | None = None, order: Sequence[str] = (), ts: Column | None = None) -> Index:
    """Indexes a table of documents."""
    docs = analyzed(assign_segments(df, docs_per_segment, position, order), fields, ts)
    postings = build_postings(docs)
    termdict = postings.groupBy("segment", "term").agg(F.count("*").alias("df"))
    return Index(docs.drop("tokens"), postings, termdict, segment_stats(docs, termdict))


def index_shape(index: Index) -> DataFrame:
    """Documents, distinct terms, postings and the average length of the whole index."""
    sums = index.segments.agg(F.coalesce(F.sum("num_docs"), F.lit(0)).alias("num_docs"), F.coalesce(F.sum("num_postings"), F.lit(0)).alias("num_postings"), F.sum("total_length").alias("t"))
    terms = index.termdict.agg(F.count_distinct("term").alias("num_terms"))
    average = F.coalesce(F.try_divide("t", "num_docs"), F.lit(0.0))
    return sums.join(terms).select("num_docs", "num_terms", "num_postings", average.alias("avg_length"))


def term_df(index: Index) -> DataFrame:
    """(term, df) over all segments."""
    return index.termdict.groupBy("term").agg(F.sum("df").alias("df"))


def top_terms(index: Index, n: int = 10) -> DataFrame:
    """The most common terms, ties by term."""
    return term_df(index).orderBy(F.desc("df"), "term").limit(n)


def posting_lists(index: Index) -> DataFrame:
    """(segment, term, doc_ids, gaps, tfs): nested lists, ascending by document."""
    nested = index.postings.groupBy("segment", "term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    ids = F.col("p.doc_id")
    return nested.select("segment", "term", ids.alias("doc_ids"), delta_encode(ids).alias("gaps"), F.col("p.tf").alias("tfs"))


def contains_terms(index: Index, terms: Sequence[str]) -> DataFrame:
    """(segment, term) of the asked terms that a segment has; reads no postings."""
    return index.termdict.filter(F.col("term").isin(*terms)).select("segment", "term")
