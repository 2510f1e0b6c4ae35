"""Token counts without tokenising documents.

The pieces of each distinct pre-token are counted once. Documents are reduced to pre-token frequencies, and a
document's count is the sum of frequency times pieces over the join of the two; ids are never made for a text.

Two passes read the texts. The first finds the distinct pre-tokens and how often each occurs. The HEAD most
frequent ones (a fixed number, whatever the input) are broadcast, so most of the second pass's frequencies, counted
for each document, are joined where they arise; the rest, rare by construction and so free of hot keys, is joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of, written
from .pieces import MODEL, load_proto, pretokens

#: The bound on broadcast pre-tokens.
HEAD = 250_000
#: Distinct pre-tokens that a task of the first pass holds before it passes them on.
HELD = 300_000
LIMIT = 4096


class PieceCounter:
    """Pieces of pre-tokens, by the library. A leading line feed keeps a pre-token apart from the added space."""

    def __init__(self, model: str | None = None):
        import public_tokenizers
        import sentencepiece

        load_proto(model)
        self.library = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path(MODEL))
        self.lead = len(self.library.encode("\n"))

    def __call__(self, tokens: list[str]) -> list[int]:
        return [len(x) - self.lead for x in self.library.encode(["\n" + t for t in tokens], num_threads=1)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def flush() -> Iterator[pa.RecordBatch]:
        tokens, counts = list(seen), list(seen.values())
        for i in range(0, len(tokens), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(tokens[i : i + 50_000]), pa.array(counts[i : i + 50_000], pa.int64())], schema=schema)
        seen.clear()

    for batch in batches:
        for text in batch.column(1).to_pylist():
            if text:
                seen.update(pretokens(text))
        if len(seen) > HELD:
            yield from flush()
    yield from flush()


def pretoken_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(token, n, pieces) of every distinct pre-token of a (doc_id, text) table."""
    distinct = docs.mapInArrow(_frequencies, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))

    def make():
        count = PieceCounter(model)
        return lambda b: {"token": b.column(0), "n": b.column(1), "pieces": count(b.column(0).to_pylist())}

    return map_batches(distinct, make, "token string, n long, pieces int")


def _head(vocabulary: DataFrame, size: int) -> dict[str, int]:
    """At most ``size`` of the most frequent pre-tokens: all those above a frequency that so many can have."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = vocabulary.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # some hundred at most
    total, least = 0, None
    for row in levels:
        total += row["count"]
        if total > size:
            break
        least = row["level"]
    if least is None:
        return {}
    found = vocabulary.filter(level >= least).select("token", "pieces").collect()
    return {r[0]: r[1] for r in found}


def _second_pass(head):
    schema = pa.schema([("key", pa.int64()), ("token", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key = head.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, tokens, ns, ids, sizes = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, rare = 0, {}
                for token, times in Counter(pretokens(text)).items() if text else ():
                    n = known.get(token)
                    if n is None:
                        rare[token] = times
                    else:
                        total += times * n
                # The document's own row: a token that no text has keeps it out of the join.
                keys.append(key)
                tokens.append(f"\n{key}")
                ns.append(total)
                ids.append(doc_id)
                sizes.append(len(text.encode()) if text else 0)
                keys += [key] * len(rare)
                tokens += rare
                ns += rare.values()
                ids += [None] * len(rare)
                sizes += [None] * len(rare)
                key += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, tokens, ns, ids, sizes), schema, strict=True)], schema=schema)

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, model: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row for each row.

    Null and empty texts have no tokens. Repeated rows and null ids each keep their row; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = texts_of(docs, id_col, text_col)
    vocabulary = written(pretoken_counts(rows, model))
    known = docs.sparkSession.sparkContext.broadcast(_head(vocabulary, head))
    parts = rows.mapInArrow(_second_pass(known), "key long, token string, n long, doc_id long, n_bytes long")
    joined = parts.join(vocabulary.select("token", "pieces"), "token", "left")
    total = joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def brute_force(texts: list[str | None]) -> np.ndarray:
    """The library's own counts, for tests."""
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    return np.array([len(library.encode(t or "")) for t in texts])
