"""Every query of the engine over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.text import STOPWORDS
from ..operators import dataset, metrics, search, sessions
from ..operators.index import contains_terms, index_shape, posting_lists, term_df, top_terms
from ..operators.model import demo_ensemble, score_column
from ..operators.search import Options
from ..sources import clickstream, tables
from . import manifest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL pieces

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: len(t) >= 2 and t not in ({_STOP}))"


def _index(source: str, tokens: str, position: str, size: int, ts: str) -> str:
    return f"""
docs AS (SELECT {position} // {size} AS segment, {position} % {size} AS doc_id, {ts} AS ts, {tokens} AS toks FROM {source}),
lens AS (SELECT segment, doc_id, ts, len(toks) AS length FROM docs),
occ AS (SELECT segment, doc_id, unnest(toks) AS term FROM docs),
postings AS (SELECT segment, doc_id, term, count(*) AS tf FROM occ GROUP BY ALL),
termdict AS (SELECT segment, term, count(*) AS df FROM postings GROUP BY ALL),
segments AS (SELECT segment, count(*) AS n, sum(length) AS total, min(ts) AS min_ts, max(ts) AS max_ts FROM lens GROUP BY ALL)"""


_CORPUS = _index("documents", _tokens("text"), "doc_id", tables.DOCS_PER_SEGMENT, f"doc_id + {tables.FIRST_TS}")
_CATALOG = _index("part", f"list_concat(list_concat({_tokens('p_name')}, {_tokens('p_type')}), {_tokens('p_brand')})", "(p_partkey - 1)", 500, "p_partkey - 1")
_PAGES = _index("pages", _tokens("regexp_replace(html, '<[^>]*>', ' ', 'g')"), "page_id", tables.DOCS_PER_SEGMENT, "page_id")


def _matches(index: str, terms: list[str], o: Options) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    where = " AND ".join([f"max_ts >= {o.start}"] * (o.start is not None) + [f"min_ts <= {o.end}"] * (o.end is not None)) or "true"
    if o.global_stats:
        weight = "(SELECT term, sum(df) AS df FROM termdict SEMI JOIN live USING (segment) WHERE term IN (" + names + ") GROUP BY term)"
        stats = f"SELECT l.segment, w.term, w.df, c.n, c.total FROM live l CROSS JOIN {weight} w CROSS JOIN (SELECT sum(n) AS n, sum(total) AS total FROM live) c"
    else:
        stats = f"SELECT t.segment, t.term, t.df, l.n, l.total FROM termdict t JOIN live l USING (segment) WHERE t.term IN ({names})"
    idf = "ln(1 + (s.n - s.df + 0.5) / (s.df + 0.5))"
    tf = f"p.tf * ({o.k1} + 1) / (p.tf + {o.k1} * (1 - {o.b} + {o.b} * d.length / (s.total / s.n)))"
    having = f"HAVING count(*) = {len(terms)}" if o.mode == "and" else ""
    return f"""WITH {index}, live AS (SELECT * FROM segments WHERE {where}), stats AS ({stats}),
found AS (SELECT p.segment, p.doc_id, round(sum({idf} * {tf}), 6) AS score FROM postings p JOIN lens d USING (segment, doc_id) JOIN stats s ON s.segment = p.segment AND s.term = p.term GROUP BY p.segment, p.doc_id {having})"""


def _page(index: str, terms: list[str], o: Options) -> str:
    return _matches(index, terms, o) + f""" SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY score DESC, segment, doc_id) AS INTEGER) AS rank, segment, doc_id, score FROM found) WHERE rank > {o.offset} AND rank <= {o.offset + o.top_k}"""


def _searches(name: str, text: str, o: Options, corpus=tables.corpus, index: str = _CORPUS) -> None:
    from ..functions.text import query_terms

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(corpus(spark, sf_dir), text, o, digits=6)

    run.__name__ = name
    query(_page(index, sorted(set(query_terms(text))), o))(run)


_FROM = tables.FIRST_TS
for _name, _text, _options in (
    ("bm25_and", "tion er", Options(global_stats=True)),
    ("bm25_or", "tion er", Options("or", global_stats=True)),
    ("bm25_local_stats", "tion er", Options()),
    ("bm25_local_or", "tion er", Options("or")),
    ("bm25_global_stats", "er on re", Options(global_stats=True)),
    ("bm25_one_term", "der", Options(global_stats=True)),
    ("bm25_rare_term", "worthless", Options(global_stats=True)),
    ("bm25_three_terms", "tion er on", Options(global_stats=True)),
    ("bm25_time_pruned", "tion er", Options("or", global_stats=True, start=_FROM + 120, end=_FROM + 340)),
    ("bm25_page2", "tion er", Options("or", offset=10, global_stats=True)),
    ("bm25_params_k1_b", "tion er", Options("or", global_stats=True, k1=2.0, b=0.3)),
):
    _searches(_name, _text, _options)
_searches("multi_field_search", "brand 12", Options("or", global_stats=True), tables.catalog, _CATALOG)
_searches("page_search", "er the on", Options("or", global_stats=True), tables.web_pages, _PAGES)


@query(_matches(_CORPUS, ["absentterm"], Options()) + " SELECT segment, doc_id, score FROM found")
def bm25_absent_term(spark, sf_dir):
    return search.matches(tables.corpus(spark, sf_dir), "absentterm")


@query("SELECT CAST(0 AS BIGINT) AS total")
def stopwords_only(spark, sf_dir):
    return search.total_hits(tables.corpus(spark, sf_dir), "the of and")


@query(_matches(_CORPUS, ["er", "tion"], Options()) + " SELECT count(*) AS total FROM found")
def match_and_count(spark, sf_dir):
    return search.total_hits(tables.corpus(spark, sf_dir), "tion er")


@query(_matches(_CORPUS, ["er", "tion"], Options("or")) + " SELECT count(*) AS total FROM found")
def match_or_count(spark, sf_dir):
    return search.total_hits(tables.corpus(spark, sf_dir), "tion er", Options("or"))


@query(f"WITH {_CORPUS} SELECT segment, doc_id FROM postings WHERE term = 'tion' INTERSECT SELECT segment, doc_id FROM postings WHERE term = 'er'")
def postings_intersect(spark, sf_dir):
    p = tables.corpus(spark, sf_dir).postings
    return search.intersect(p.filter("term = 'tion'"), p.filter("term = 'er'"))


@query(f"WITH {_CORPUS} SELECT segment, doc_id FROM postings WHERE term = 'tion' UNION SELECT segment, doc_id FROM postings WHERE term = 'er'")
def postings_union(spark, sf_dir):
    p = tables.corpus(spark, sf_dir).postings
    return search.union(p.filter("term = 'tion'"), p.filter("term = 'er'"))


@query(f"WITH {_CORPUS} SELECT term, CAST(sum(df) AS BIGINT) AS df FROM termdict GROUP BY term")
def term_frequencies(spark, sf_dir):
    return term_df(tables.corpus(spark, sf_dir))


@query(f"WITH {_CORPUS} SELECT term, CAST(sum(df) AS BIGINT) AS df FROM termdict GROUP BY term ORDER BY df DESC, term LIMIT 20")
def top_term_list(spark, sf_dir):
    return top_terms(tables.corpus(spark, sf_dir), 20)


@query(f"WITH {_CORPUS} SELECT segment, term, doc_id, CAST(tf AS INTEGER) AS tf, CAST(length AS INTEGER) AS length FROM postings JOIN lens USING (segment, doc_id)")
def postings_build(spark, sf_dir):
    return tables.corpus(spark, sf_dir).postings


@query(f"""WITH {_CORPUS} SELECT segment, term, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY segment, term ORDER BY doc_id), 0) AS gap, CAST(row_number() OVER (PARTITION BY segment, term ORDER BY doc_id) - 1 AS INTEGER) AS place FROM postings""")
def posting_gaps(spark, sf_dir):
    lists = posting_lists(tables.corpus(spark, sf_dir))
    return lists.select("segment", "term", F.posexplode("gaps").alias("place", "gap"))


@query(f"""WITH {_CORPUS} SELECT (SELECT count(*) FROM lens) AS num_docs, CAST((SELECT count(*) FROM postings) AS BIGINT) AS num_postings, (SELECT count(DISTINCT term) FROM termdict) AS num_terms, round((SELECT avg(length) FROM lens), 6) AS avg_length""")
def corpus_shape(spark, sf_dir):
    return index_shape(tables.corpus(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


@query(f"""WITH {_CORPUS} SELECT segment, s.n AS num_docs, t.nt AS num_terms, CAST(t.np AS BIGINT) AS num_postings, CAST(s.total AS BIGINT) AS total_length, s.min_ts, s.max_ts
FROM segments s JOIN (SELECT segment, count(*) AS nt, sum(df) AS np FROM termdict GROUP BY segment) t USING (segment)""")
def segment_stats(spark, sf_dir):
    return tables.corpus(spark, sf_dir).segments


@query(f"WITH {_CORPUS} SELECT segment, doc_id, CAST(length AS INTEGER) AS length FROM lens")
def doc_lengths(spark, sf_dir):
    return tables.corpus(spark, sf_dir).docs.select("segment", "doc_id", "length")


@query(f"WITH {_CORPUS} SELECT segment, term FROM termdict WHERE term IN ('tion', 'worthless', 'absentterm')")
def term_presence(spark, sf_dir):
    return contains_terms(tables.corpus(spark, sf_dir), ["tion", "worthless", "absentterm"])


@query(_matches(_CORPUS, ["er", "tion"], Options("or", global_stats=True)) + f""" SELECT f.rank, f.segment, f.doc_id, f.score, d.lang, d.source FROM (SELECT CAST(row_number() OVER (ORDER BY score DESC, segment, doc_id) AS INTEGER) AS rank, * FROM found) f JOIN documents d ON d.doc_id = f.segment * {tables.DOCS_PER_SEGMENT} + f.doc_id WHERE f.rank <= 10""")
def doc_fetch(spark, sf_dir):
    index = tables.corpus(spark, sf_dir)
    hits = search.search(index, "tion er", Options("or", global_stats=True), digits=6)
    return search.fetch(index, hits, ["lang", "source"]).select("rank", "segment", "doc_id", "score", "lang", "source")


@query(f"""WITH {_CORPUS}, live AS (SELECT segment FROM segments WHERE max_ts >= {_FROM + 120} AND min_ts <= {_FROM + 340})
SELECT (SELECT count(*) FROM segments) AS segments_total, (SELECT count(*) FROM segments) - (SELECT count(*) FROM live) AS segments_pruned, (SELECT count(*) FROM live) AS segments_searched,
CAST(coalesce((SELECT sum(df) FROM termdict SEMI JOIN live USING (segment) WHERE term IN ('tion', 'er')), 0) AS BIGINT) AS postings_read""")
def query_cost(spark, sf_dir):
    return search.cost(tables.corpus(spark, sf_dir), "tion er", Options(start=_FROM + 120, end=_FROM + 340))


# ---- Clickstream

_EVENTS = f"""
ev AS (SELECT printf('r_%09d', e.event_id) AS event_id, CAST(floor(epoch_us(e.ts) / 1000000) AS BIGINT) AS ts, CAST(e.user_id AS VARCHAR) || '-' || CAST(weekofyear(e.ts) AS VARCHAR) AS session_id,
CAST(e.user_id AS VARCHAR) AS user_id, CASE e.event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'remove_from_cart' WHEN 'purchase' THEN 'purchase' END AS event_type,
regexp_extract(e.props, '([0-9]+)', 1) AS product_id, p.p_type AS category, p.p_brand AS brand, e.value AS price
FROM events e LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = regexp_extract(e.props, '([0-9]+)', 1))"""

_STATE = _EVENTS + """,
s1 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NOT NULL THEN greatest(0, ts - lag(ts) OVER w) END AS gap, first_value(ts) OVER w AS first_ts, row_number() OVER w AS n,
sum((event_type = 'view')::INT) OVER w AS views, sum((event_type = 'click')::INT) OVER w AS clicks, sum((event_type = 'add_to_cart')::INT) OVER w AS cart_adds,
sum((event_type = 'remove_from_cart')::INT) OVER w AS cart_removes, sum((event_type = 'purchase')::INT) OVER w AS cycle,
coalesce(sum(price) OVER w, 0) AS price_sum, count(price) OVER w AS price_count, greatest(0, coalesce(max(price) OVER w, 0)) AS price_max,
(row_number() OVER (PARTITION BY session_id, product_id ORDER BY ts, event_id) = 1 AND product_id <> '')::INT AS fp,
(row_number() OVER (PARTITION BY session_id, category ORDER BY ts, event_id) = 1 AND category IS NOT NULL)::INT AS fc,
(row_number() OVER (PARTITION BY session_id, brand ORDER BY ts, event_id) = 1 AND brand IS NOT NULL)::INT AS fb
FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
s2 AS (SELECT *, sum(gap) OVER w AS gap_sum, count(gap) OVER w AS gap_count, max(gap) OVER w AS gap_max, sum(fp) OVER w AS products, sum(fc) OVER w AS categories, sum(fb) OVER w AS brands,
CASE WHEN product_id <> '' AND event_type = 'add_to_cart' AND price IS NOT NULL THEN price WHEN product_id <> '' AND event_type = 'remove_from_cart' THEN 0 END AS v,
CASE WHEN product_id <> '' AND event_type = 'add_to_cart' AND price IS NOT NULL THEN 1 WHEN product_id <> '' AND event_type = 'remove_from_cart' THEN 0 END AS i
FROM s1 WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
s3 AS (SELECT *, v - coalesce(last_value(v IGNORE NULLS) OVER b, 0) AS dv, i - coalesce(last_value(i IGNORE NULLS) OVER b, 0) AS di
FROM s2 WINDOW b AS (PARTITION BY session_id, cycle, product_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, coalesce(sum(dv) OVER c, 0) AS cart_value, coalesce(sum(di) OVER c, 0) AS cart_size, sum((event_type = 'add_to_cart' AND product_id <> '')::INT) OVER c AS open_adds,
max(cycle) OVER (PARTITION BY session_id) AS last_cycle FROM s3 WINDOW c AS (PARTITION BY session_id, cycle ORDER BY ts, event_id))"""

_FEATURES = """n AS events, views, clicks, 0 AS searches, cart_adds, cart_removes, cart_size, cart_value, ln(1 + cart_value) AS log_cart_value, products AS distinct_products, categories AS distinct_categories,
brands AS distinct_brands, CASE WHEN price_count > 0 THEN price_sum / price_count ELSE 0 END AS mean_price, price_max AS max_price, ln(1 + price_max) AS log_max_price, ts - first_ts AS duration, ln(1 + ts - first_ts) AS log_duration,
CASE WHEN gap_count > 0 THEN gap_sum / gap_count ELSE 0 END AS mean_gap, coalesce(gap_max, 0) AS max_gap, CASE WHEN ts > first_ts THEN n * 60.0 / (ts - first_ts) ELSE 0 END AS events_per_minute, views / n AS view_ratio, cart_adds / n AS cart_add_ratio,
cart_removes / greatest(cart_adds, 1) AS remove_ratio, cart_adds / greatest(views, 1) AS cart_to_view_ratio, (ts % 86400) / 3600 AS hour_of_day, ((ts // 86400 + 4) % 7 >= 5)::INT AS is_weekend, 0 AS is_mobile"""

_EXAMPLES = _STATE + f""", ex AS (SELECT session_id, n - 1 AS event_index, first_ts AS session_start, cycle = last_cycle AS abandoned, {_FEATURES} FROM st WHERE event_type <> 'purchase' AND open_adds > 0)"""


@query(f"WITH {_EVENTS} SELECT event_id, ts, session_id, user_id, event_type, product_id, category, brand, price FROM ev")
def normalize_events(spark, sf_dir):
    return tables.clickstream(spark, sf_dir).select("event_id", "ts", "session_id", "user_id", "event_type", "product_id", "category", "brand", "price")


@query(f"WITH {_EVENTS} SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def event_type_counts(spark, sf_dir):
    return clickstream.type_counts(tables.clickstream(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT count(*) AS rows_read, 0::BIGINT AS rows_skipped, count(*) AS events, count(*) FILTER (brand IS NULL) AS missing_brand, count(*) FILTER (category IS NULL) AS missing_category, count(*) AS missing_title, min(ts) AS first_ts, max(ts) AS last_ts FROM ev")
def load_stats(spark, sf_dir):
    return clickstream.load_stats(tables.clickstream(spark, sf_dir).withColumn("reason", F.lit(None).cast("string")))


@query(f"""WITH {_EVENTS}, num AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM ev), first AS (SELECT session_id, min(rn) AS f FROM num WHERE rn < 400000 GROUP BY 1 ORDER BY f LIMIT 2000)
SELECT event_id, session_id FROM num SEMI JOIN first USING (session_id) WHERE rn < 2000000""")
def session_slice(spark, sf_dir):
    return clickstream.slice_sessions(tables.clickstream(spark, sf_dir), session="session_id", seq="event_id").select("event_id", "session_id")


def _state(spark, sf_dir):
    return sessions.session_state(tables.clickstream(spark, sf_dir))


@query(f"WITH {_STATE} SELECT event_id, CAST(gap AS BIGINT) AS gap, CAST(coalesce(gap_sum, 0) AS BIGINT) AS gap_sum, gap_count, CAST(coalesce(gap_max, 0) AS BIGINT) AS gap_max FROM st")
def session_gaps(spark, sf_dir):
    return _state(spark, sf_dir).select("event_id", "gap", "gap_sum", "gap_count", "gap_max")


@query(f"WITH {_STATE} SELECT event_id, CAST(cycle AS BIGINT) AS cycle, CAST(open_adds AS BIGINT) AS open_adds FROM st")
def cart_cycles(spark, sf_dir):
    return _state(spark, sf_dir).select("event_id", "cycle", "open_adds")


@query(f"WITH {_STATE} SELECT event_id, CAST(cart_size AS BIGINT) AS cart_size, round(cart_value, 4) + 0.0 AS cart_value FROM st")
def running_cart_value(spark, sf_dir):
    return _state(spark, sf_dir).select("event_id", F.col("cart_size").cast("long").alias("cart_size"), (F.round("cart_value", 4) + 0.0).alias("cart_value"))


@query(f"WITH {_STATE} SELECT event_id, CAST(products AS BIGINT) AS products, CAST(categories AS BIGINT) AS categories, CAST(brands AS BIGINT) AS brands FROM st")
def running_distinct(spark, sf_dir):
    return _state(spark, sf_dir).select("event_id", "products", "categories", "brands")


_ROUNDED = ", ".join(f"round(CAST({f} AS DOUBLE), 6) + 0.0 AS {f}" for f in sessions.FEATURES)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[(F.round(f, 6) + 0.0).alias(f) for f in sessions.FEATURES])


@query(f"WITH {_STATE}, f AS (SELECT session_id, n - 1 AS event_index, {_FEATURES} FROM st) SELECT session_id, CAST(event_index AS INTEGER) AS event_index, {_ROUNDED} FROM f")
def session_features(spark, sf_dir):
    return _rounded(sessions.feature_rows(_state(spark, sf_dir)), "session_id", "event_index")


@query(f"WITH {_EXAMPLES} SELECT session_id, CAST(event_index AS INTEGER) AS event_index, session_start, abandoned FROM ex")
def abandonment_labels(spark, sf_dir):
    return dataset.examples(tables.clickstream(spark, sf_dir)).select("session_id", "event_index", "session_start", "abandoned")


@query(f"""WITH {_EXAMPLES}, per AS (SELECT session_id, count(*) AS n, count(*) FILTER (abandoned) AS lost FROM ex GROUP BY 1)
SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(DISTINCT session_id) FROM ev) AS sessions, count(*) AS sessions_with_cart, count(*) FILTER (lost < n) AS sessions_converted,
(SELECT count(DISTINCT session_id) FROM ev) - count(*) AS dropped_no_cart, CAST(sum(n) AS BIGINT) AS examples, round(sum(lost) / sum(n), 6) AS abandonment_rate FROM per""")
def dataset_stats(spark, sf_dir):
    e = tables.clickstream(spark, sf_dir)
    return dataset.dataset_stats(e, dataset.examples(e)).withColumn("abandonment_rate", F.round("abandonment_rate", 6))


_SPLIT = _EXAMPLES + """, starts AS (SELECT session_start, row_number() OVER (ORDER BY session_start) - 1 AS place, count(*) OVER () AS c FROM (SELECT DISTINCT session_start FROM ex)),
cut AS (SELECT session_start AS cutoff FROM starts WHERE place = greatest(0, CAST(floor(c * 0.7) AS BIGINT) - 1))"""


@query(f"WITH {_SPLIT} SELECT session_start <= cutoff AS is_train, count(*) AS examples, count(DISTINCT session_id) AS sessions FROM ex CROSS JOIN cut GROUP BY 1")
def time_split_sizes(spark, sf_dir):
    rows = dataset.time_split(dataset.examples(tables.clickstream(spark, sf_dir)))
    return rows.groupBy("is_train").agg(F.count("*").alias("examples"), F.count_distinct("session_id").alias("sessions"))


@query(f"WITH {_SPLIT} SELECT session_id FROM ex CROSS JOIN cut GROUP BY 1 HAVING count(DISTINCT session_start <= cutoff) > 1 UNION ALL SELECT 'by index ' || session_id FROM ex GROUP BY 1 HAVING count(DISTINCT event_index % 2) > 1")
def split_overlap(spark, sf_dir):
    """No session of the split in time, and those that a split by place in the session tears apart."""
    rows = dataset.examples(tables.clickstream(spark, sf_dir))
    torn = dataset.session_overlap(rows.withColumn("is_train", F.col("event_index") % 2 == 0))
    return dataset.session_overlap(dataset.time_split(rows)).unionByName(torn.select(F.concat(F.lit("by index "), "session_id").alias("session_id")))


_PARTED = _EVENTS + ", pe AS (SELECT *, CAST(user_id AS BIGINT) % 12 AS part FROM ev)"


def _parted(spark, sf_dir):
    return tables.clickstream(spark, sf_dir).withColumn("part", F.col("user_id").cast("long") % 12)


@query(f"WITH {_PARTED} SELECT part, max(ts) AS watermark FROM pe GROUP BY 1")
def partition_watermarks(spark, sf_dir):
    return sessions.watermarks(_parted(spark, sf_dir), "part")


@query(f"""WITH {_PARTED}, wm AS (SELECT part, max(ts) AS watermark FROM pe GROUP BY 1), last AS (SELECT part, session_id, max(ts) AS last_ts FROM pe GROUP BY ALL)
SELECT session_id, last_ts, watermark FROM last JOIN wm USING (part) WHERE watermark - last_ts > 1800""")
def expired_sessions(spark, sf_dir):
    return sessions.expired_sessions(_parted(spark, sf_dir), "part")


@query(f"WITH {_STATE} SELECT event_id, CASE WHEN open_adds <= 0 THEN 'no open cart' WHEN n < 2 THEN 'fewer than two events' END AS why_not FROM st")
def scoring_gate(spark, sf_dir):
    return _state(spark, sf_dir).select("event_id", sessions.scoring_gate().alias("why_not"))


# ---- Model

_TREES = demo_ensemble().sql()
_SCORED = _EXAMPLES + f", sc AS (SELECT session_id, event_index, abandoned AS y, round(1 / (1 + exp(-({_TREES}))), 6) AS p FROM ex)"


def _scored(spark, sf_dir):
    rows = dataset.examples(tables.clickstream(spark, sf_dir))
    return rows.select("session_id", "event_index", F.col("abandoned").alias("y"), F.round(score_column(demo_ensemble()), 6).alias("p"))


@query(f"WITH {_SCORED} SELECT session_id, CAST(event_index AS INTEGER) AS event_index, p, p >= 0.7 AS at_risk FROM sc")
def tree_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("session_id", "event_index", "p", (F.col("p") >= sessions.AT_RISK).alias("at_risk"))


@query(f"WITH {_SCORED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, round(avg(p), 6) AS predicted, round(avg(y::INT), 6) AS observed, count(*) AS n FROM sc GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return metrics.calibration(_scored(spark, sf_dir)).select("bin", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"), "n")


@query(f"WITH {_SCORED} SELECT round(avg(-CASE WHEN y THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round(avg((p - y::INT) ** 2), 6) AS brier, round(avg(y::INT), 6) AS base_rate, count(*) AS examples FROM sc")
def brier_logloss(spark, sf_dir):
    return metrics.losses(_scored(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "base_rate")], "examples")


@query(f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM sc)
SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS roc_auc FROM r""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""WITH {_SCORED}, l AS (SELECT p, sum(y::INT) AS pos, count(*) AS n FROM sc GROUP BY p), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM l WINDOW w AS (ORDER BY p DESC))
SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c""")
def avg_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


# ---- Lifecycle, on the corpus's segments as manifest entries

_META = f"{_CORPUS}, meta AS (SELECT printf('segments/%012d-%012d.seg', segment * 100, segment * 100 + n - 1) AS key, n AS docs, total * 8 AS bytes, min_ts, max_ts, segment * 100 AS first_offset, segment * 100 + n - 1 AS last_offset FROM segments)"


def _meta(spark, sf_dir):
    return manifest.entries_of(tables.corpus(spark, sf_dir), tables.DOCS_PER_SEGMENT)


@query(f"WITH {_META} SELECT key, docs, CAST(bytes AS BIGINT) AS bytes, min_ts, max_ts, first_offset, last_offset FROM meta")
def manifest_entries(spark, sf_dir):
    return _meta(spark, sf_dir)


@query(f"WITH {_META} SELECT CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS segments FROM meta")
def manifest_totals(spark, sf_dir):
    return _meta(spark, sf_dir).agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"), F.count("*").alias("segments"))


@query(f"""WITH {_META} SELECT key FROM meta WHERE NOT (key = 'segments/replay.seg' OR (first_offset <= 349 AND 150 <= last_offset)) UNION ALL SELECT 'segments/replay.seg'""")
def manifest_publish_evict(spark, sf_dir):
    new = spark.createDataFrame([("segments/replay.seg", 200, 0, 0, 0, 150, 349)], "key string, docs long, bytes long, min_ts long, max_ts long, first_offset long, last_offset long")
    return manifest.publish_rows(_meta(spark, sf_dir), new).select("key")


@query(f"WITH {_META} SELECT DISTINCT key FROM (SELECT key FROM meta WHERE first_offset < 500 UNION ALL SELECT key FROM meta WHERE first_offset >= 300)")
def manifest_union(spark, sf_dir):
    m = _meta(spark, sf_dir)
    return manifest.union_rows([m.filter("first_offset < 500"), m.filter("first_offset >= 300")]).select("key")


@query(f"WITH {_META} SELECT key FROM meta WHERE first_offset % 300 = 0")
def orphans(spark, sf_dir):
    m = _meta(spark, sf_dir)
    return manifest.orphan_rows(m.select("key"), m.filter("first_offset % 300 <> 0"))


@query(f"WITH {_META} SELECT key FROM meta WHERE max_ts >= {_FROM + 120} AND min_ts <= {_FROM + 340}")
def time_overlap_prune(spark, sf_dir):
    return search.overlapping(_meta(spark, sf_dir), _FROM + 120, _FROM + 340).select("key")


@query(f"""WITH RECURSIVE {_META}, ordered AS (SELECT *, row_number() OVER (ORDER BY first_offset, key) AS i FROM meta),
walk AS (SELECT i, i AS begins, 1 AS len, bytes AS most, bytes AS least, bytes AS total FROM ordered WHERE i = 1 UNION ALL
SELECT i, CASE WHEN fits THEN begins ELSE i END, CASE WHEN fits THEN len + 1 ELSE 1 END, CASE WHEN fits THEN greatest(most, bytes) ELSE bytes END, CASE WHEN fits THEN least(least, bytes) ELSE bytes END, CASE WHEN fits THEN total + bytes ELSE bytes END
FROM (SELECT o.i, o.bytes, w.begins, w.len, w.most, w.least, w.total, w.len < 3 AND o.bytes <= 4 * w.most AND o.bytes * 4 >= w.least AND w.total + o.bytes <= 268435456 AS fits FROM walk w JOIN ordered o ON o.i = w.i + 1)),
runs AS (SELECT begins, row_number() OVER (ORDER BY begins) - 1 AS grp FROM walk WHERE len = 3),
members AS (SELECT r.grp, r.begins, o.* FROM runs r JOIN ordered o ON o.i BETWEEN r.begins AND r.begins + 2)
SELECT CAST(grp AS INTEGER) AS grp, key, printf('segments/%020d-%020d.seg', min(first_offset) OVER (PARTITION BY grp), max(last_offset) OVER (PARTITION BY grp)) AS merged FROM members""")
def compaction_plan(spark, sf_dir):
    rows = manifest.plan_compaction(manifest.metas(_meta(spark, sf_dir)), merge_factor=3)
    return spark.createDataFrame([(g, s.key, manifest.merged_key(group)) for g, group in enumerate(rows) for s in group], "grp int, key string, merged string")


@query(f"WITH {_CORPUS} SELECT CAST(coalesce(max(segment * 100 + n - 1) + 1, 0) AS BIGINT) AS next_offset FROM segments")
def next_offset(spark, sf_dir):
    return _meta(spark, sf_dir).agg(F.coalesce(F.max("last_offset") + 1, F.lit(0)).cast("long").alias("next_offset"))


def _crc(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda t: ascii(t)::BIGINT)), lambda c, b: {bits}), 4294967295)"


def _word(words: tuple[tuple[str, int], ...], digest: str) -> str:
    ends = list(accumulate(w for _, w in words))
    return f"CASE {' '.join(f'WHEN {digest} % {ends[-1]} < {end} THEN {chr(39)}{word.capitalize()}{chr(39)}' for (word, _), end in zip(words, ends, strict=True))} END"


@query(f"""WITH d AS (SELECT p_partkey, lower(p_brand) AS brand, split_part(lower(p_type), ' ', -1) AS leaf, {_crc("p_partkey::VARCHAR || 'color'")} AS c, {_crc("p_partkey::VARCHAR || 'modifier'")} AS m, {_crc("p_partkey::VARCHAR || 'model'")} AS k FROM part)
SELECT p_partkey, concat_ws(' ', upper(brand[1]) || brand[2:], {_word(titles.COLORS, 'c')}, {_word(titles.MODIFIERS, 'm')}, upper(leaf[1]) || leaf[2:], chr(CAST(65 + k % 26 AS INTEGER)) || lpad(CAST((k // 26) % 1000 AS VARCHAR), 3, '0')) AS title FROM d""")
def product_titles(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    return p.select("p_partkey", titles.derive_title(F.col("p_partkey").cast("string"), F.lower("p_brand"), F.lower(F.replace("p_type", F.lit(" "), F.lit(".")))).alias("title"))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship query: the ten best documents for two terms, with what is stored of them."""
    index = tables.corpus(spark, sf_dir)
    return search.fetch(index, search.search(index, "tion er", Options(global_stats=True), digits=6), ["lang", "source"])


