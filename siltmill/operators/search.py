"""BM25 search as one plan: postings of the query's terms, joined to their weights, summed by document.

Which documents match (all terms or any) is a condition on the sum's group, so matching and scoring share one
shuffle of the matching postings. Top-k is a sort with a limit, which Spark runs in every partition first;
documents are fetched after it.

A stored index is searched in two steps. The term dictionary says first which of the at most MAX_TERMS terms are in
which segments; a query that nothing can match ends there. Then only the segments that can match are opened, with the
terms as filters that reach the files' statistics and bloom filters, and the weights - a row for each term and segment
that is left - are broadcast. An index of more than PLANNED segments is searched in one lazy plan instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import B, K1, check_bm25, idf, query_terms, term_score
from .index import Index

# Limits of a query from outside.
MAX_QUERY, MAX_TERMS, MAX_K, MAX_OFFSET = 256, 16, 100, 500
#: Segments up to which a stored index's dictionary rows and statistics are taken to the driver.
PLANNED = 10_000


@dataclass(frozen=True)
class Options:
    mode: str = "and"
    top_k: int = 10
    offset: int = 0
    global_stats: bool = False
    start: int | None = None
    end: int | None = None
    k1: float = K1
    b: float = B
    #: Only documents inside the window, not all those of segments that touch it.
    exact_window: bool = False

    def __post_init__(self):
        if self.mode not in ("and", "or"):
            raise ValueError(f"mode must be 'and' or 'or', not {self.mode!r}")
        if self.offset < 0 or self.top_k < 0:
            raise ValueError("offset and top_k must not be negative")
        check_bm25(self.k1, self.b)


def guard(query: str, k: int, offset: int) -> list[str]:
    """The terms of a query from outside, repeats included, or a ValueError."""
    if len(query) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    if not 1 <= k <= MAX_K or not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"k must be 1 to {MAX_K} and offset 0 to {MAX_OFFSET}")
    terms = query_terms(query)
    if len(terms) > MAX_TERMS:
        raise ValueError(f"a query has at most {MAX_TERMS} terms")
    return terms


def overlapping(segments: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Segments that could hold something in a time window, both ends included."""
    if start is not None:
        segments = segments.filter(F.col("max_ts") >= start)
    if end is not None:
        segments = segments.filter(F.col("min_ts") <= end)
    return segments


def weights(index: Index, terms: Sequence[str], segments: DataFrame, global_stats: bool) -> DataFrame:
    """(segment, term, weight, average): idf and average length, of the segment or of all that are searched."""
    own = index.termdict.filter(F.col("term").isin(*terms)).join(segments.select("segment", "num_docs", "total_length"), "segment")
    if not global_stats:
        average = F.coalesce(F.try_divide("total_length", "num_docs"), F.lit(0.0))
        return own.select("segment", "term", idf(F.col("num_docs"), F.col("df")).alias("weight"), average.alias("average"))
    corpus = segments.agg(F.sum("num_docs").alias("n"), F.sum("total_length").alias("t"))  # one row
    dfs = own.groupBy("term").agg(F.sum("df").alias("all_df"))  # a row for each query term
    both = dfs.join(corpus).select("term", idf(F.col("n"), F.col("all_df")).alias("weight"), F.coalesce(F.try_divide("t", "n"), F.lit(0.0)).alias("average"))
    return own.select("segment", "term").join(F.broadcast(both), "term")


def in_window(stats: dict[str, dict], start: int | None, end: int | None) -> list[str]:
    """As ``overlapping``, for segments whose statistics are known."""
    return [n for n, r in stats.items() if (start is None or r["max_ts"] >= start) and (end is None or r["min_ts"] <= end)]


def planned_weights(index: Index, terms: Sequence[str], options: Options) -> tuple[DataFrame | None, list[str]]:
    """The weights of a stored index's terms and the segments that can match, from one look at the dictionary."""
    live = in_window(index.stats, options.start, options.end)
    wanted = index.termdict.filter(F.col("term").isin(*terms))
    if len(live) < len(index.stats):
        wanted = wanted.filter(F.col("segment").isin(*live))
    found: dict[str, dict[str, int]] = {}
    for r in wanted.select("segment", "term", "df").collect():
        found.setdefault(r["segment"], {})[r["term"]] = r["df"]
    enough = len(terms) if options.mode == "and" else 1
    names = sorted(n for n, dfs in found.items() if len(dfs) >= enough)
    if not names:
        return None, []
    if options.global_stats:
        n, total = (sum(index.stats[x][c] for x in live) for c in ("num_docs", "total_length"))
        dfs: dict[str, int] = {}
        for of in found.values():
            for t, df in of.items():
                dfs[t] = dfs.get(t, 0) + df
        rows = [(x, t, dfs[t], n, total) for x in names for t in found[x]]
    else:
        rows = [(x, t, df, index.stats[x]["num_docs"], index.stats[x]["total_length"]) for x in names for t, df in found[x].items()]
    # An Arrow table becomes a local relation, which takes no job to broadcast.
    names_of, terms_of, *counts = (list(x) for x in zip(*rows, strict=True))
    columns = [pa.array(names_of), pa.array(terms_of), *[pa.array(c, pa.int64()) for c in counts]]
    table = index.postings.sparkSession.createDataFrame(pa.Table.from_arrays(columns, names=["segment", "term", "df", "n", "total"]))
    return table.select("segment", "term", idf(F.col("n"), F.col("df")).alias("weight"), F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("average")), names


def matches(index: Index, query: str, options: Options = Options()) -> DataFrame:
    """(segment, doc_id, score) of every match, unordered."""
    terms = sorted(set(query_terms(query)))
    nothing = index.postings.limit(0).select("segment", "doc_id", F.lit(0.0).alias("score"))
    if not terms:
        return nothing
    postings = index.postings.filter(F.col("term").isin(*terms))
    if index.stats is None or len(terms) > MAX_TERMS:
        weighted = weights(index, terms, overlapping(index.segments, options.start, options.end), options.global_stats)
    else:
        weighted, names = planned_weights(index, terms, options)
        if not names:
            return nothing
        if len(names) < len(index.stats):
            postings = postings.filter(F.col("segment").isin(*names))
        weighted = F.broadcast(weighted)  # at most MAX_TERMS rows for each of PLANNED segments
    rows = postings.join(weighted, ["segment", "term"])
    if options.exact_window:
        inside = F.lit(True) if options.start is None else F.col("ts") >= options.start
        inside = inside if options.end is None else inside & (F.col("ts") <= options.end)
        rows = rows.join(index.docs.filter(inside).select("segment", "doc_id"), ["segment", "doc_id"], "left_semi")
    score = term_score(F.col("tf"), F.col("length"), F.col("average"), F.col("weight"), options.k1, options.b)
    if len(terms) == 1:  # a document has one posting of a term: nothing to add up, nothing to shuffle
        return rows.select("segment", "doc_id", score.alias("score"))
    found = rows.groupBy("segment", "doc_id").agg(F.sum(score).alias("score"), F.count("*").alias("n"))
    if options.mode == "and":
        found = found.filter(F.col("n") == len(terms))
    return found.select("segment", "doc_id", "score")


def search(index: Index, query: str, options: Options = Options(), digits: int | None = None) -> DataFrame:
    """(rank, segment, doc_id, score) of one page, best first; ties by segment and document.

    ``digits`` rounds scores before they are ranked. A page past the end is empty.
    """
    found = matches(index, query, options)
    if digits is not None:
        found = found.withColumn("score", F.round("score", digits))
    order = [F.desc("score"), "segment", "doc_id"]
    top = found.orderBy(*order).limit(options.offset + options.top_k)
    rank = F.row_number().over(Window.orderBy(*order))  # over one page and those before it
    return top.withColumn("rank", rank).filter(F.col("rank") > options.offset).select("rank", "segment", "doc_id", "score")


def total_hits(index: Index, query: str, options: Options = Options()) -> DataFrame:
    """One row: how many documents match."""
    return matches(index, query, options).agg(F.count("*").alias("total"))


def fetch(index: Index, hits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A page of hits with stored fields, in rank order. A page is at most MAX_K rows, so it is broadcast.

    Of a stored index the page is found first, and only its segments' folders and its documents' row groups are read.
    """
    stored = index.docs
    if index.stats is not None:
        page = hits.limit(MAX_K + 1).collect()
        if len(page) <= MAX_K:
            by: dict[str, list[int]] = {}
            for r in page:
                by.setdefault(r["segment"], []).append(r["doc_id"])
            here = F.lit(False)
            for name, ids in by.items():
                here |= (F.col("segment") == name) & F.col("doc_id").isin(*ids)
            stored = stored.filter(F.col("segment").isin(*by)).filter(here) if by else stored.limit(0)
            columns = [pa.array([r[f.name] for r in page], to_arrow_type(f.dataType)) for f in hits.schema]
            hits = stored.sparkSession.createDataFrame(pa.Table.from_arrays(columns, names=hits.columns))
    stored = stored.select("segment", "doc_id", *[f for f in fields if f not in ("segment", "doc_id")])
    return stored.join(F.broadcast(hits), ["segment", "doc_id"]).orderBy("rank")


def cost(index: Index, query: str, options: Options = Options()) -> DataFrame:
    """One row: segments in all, pruned by time, and searched, and postings read."""
    terms = sorted(set(query_terms(query)))
    live = overlapping(index.segments, options.start, options.end)
    read = index.termdict.filter(F.col("term").isin(*terms)).join(live.select("segment"), "segment", "left_semi")
    counted = index.segments.agg(F.count("*").alias("segments_total")).join(live.agg(F.count("*").alias("segments_searched")))
    return counted.join(read.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings_read"))).select("segments_total", (F.col("segments_total") - F.col("segments_searched")).alias("segments_pruned"), "segments_searched", "postings_read")


# Sets of documents, for posting lists that come from anywhere.


def intersect(*lists: DataFrame) -> DataFrame:
    """Documents that are in all lists, in one shuffle: each list's rows count once."""
    tagged = [x.select("segment", "doc_id", F.lit(i).alias("l")) for i, x in enumerate(lists)]
    both = tagged[0]
    for x in tagged[1:]:
        both = both.unionByName(x)
    return both.groupBy("segment", "doc_id").agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), l)")).alias("m")).filter(F.col("m") == (1 << len(lists)) - 1).select("segment", "doc_id")


def union(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("segment", "doc_id")
    for x in lists[1:]:
        out = out.unionByName(x.select("segment", "doc_id"))
    return out.distinct()
