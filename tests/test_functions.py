from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from siltmill.functions import text, titles
from siltmill.operators.search import MAX_QUERY, guard
from tests.reference_fold import tokens


def one(spark, column, *values, names="x"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"{names} string").select(column).collect()]


def test_tokenize(spark):
    samples = ["Samsung White Lite Smartphone L486", "electronics.smartphone", "", None, "The of a", "x 5 ab-CD_ef", "Ünïcode été", "a1 B2"]
    assert one(spark, text.tokenize("x"), *samples) == [tokens(s) for s in samples]
    assert text.query_terms("Samsung the Smartphone!") == ["samsung", "smartphone"]


def test_fields_do_not_run_together(spark):
    df = spark.createDataFrame([("ab", "cd", None)], "a string, b string, c string")
    assert df.select(text.analyze(["a", "b", "c"])).first()[0] == ["ab", "cd"]


def test_titles(spark):
    def plain(pid, brand, category):
        leaf = (category or "").rsplit(".", 1)[-1].replace("_", " ").strip()
        if not brand and not leaf:
            return None

        def pick(words, salt):
            h = zlib.crc32((pid + salt).encode()) % sum(w for _, w in words)
            for word, w in words:
                if h < w:
                    return word.title()
                h -= w

        d = zlib.crc32((pid + "model").encode())
        parts = [(brand or "").strip().title()] * bool(brand) + [pick(titles.COLORS, "color"), pick(titles.MODIFIERS, "modifier")] + [leaf.title()] * bool(leaf)
        return " ".join([*parts, f"{chr(65 + d % 26)}{d // 26 % 1000:03d}"])

    rows = [(str(1_000_000 + 977 * i), b, c) for i, (b, c) in enumerate([("samsung", "electronics.smartphone"), ("l'oreal x1a foo_bar", None), (None, "appliances.kitchen.coffee_grinder"), (None, None), ("", "a")] * 40)]
    df = spark.createDataFrame(rows, "p string, b string, c string")
    got = [r[0] for r in df.select(titles.derive_title(F.col("p"), F.col("b"), F.col("c"))).collect()]
    assert got == [plain(*r) for r in rows]
    assert plain("1004856", "samsung", "electronics.smartphone") == "Samsung White Lite Smartphone L486"


def test_scores(spark):
    df = spark.range(1)
    at = lambda c: df.select(c).first()[0]
    assert at(text.idf(F.lit(10), F.lit(0))) == 0.0
    assert at(text.idf(F.lit(10), F.lit(1))) > at(text.idf(F.lit(10), F.lit(5))) > 0
    score = lambda tf, dl: at(text.term_score(F.lit(tf), F.lit(dl), F.lit(10.0), F.lit(1.0)))
    assert score(0, 10) == 0 and score(1, 10) < score(2, 10) < 2.2 and score(1, 5) > score(1, 20)
    for k1, b in ((-1, 0.5), (1, 1.5)):
        with pytest.raises(ValueError):
            text.check_bm25(k1, b)


def test_delta(spark):
    df = spark.createDataFrame([([3, 4, 9, 1000],)], "a array<long>")
    gaps = df.select(text.delta_encode(F.col("a")).alias("g"))
    assert gaps.first()[0] == [3, 1, 5, 991]
    assert gaps.select(text.delta_decode(F.col("g"))).first()[0] == [3, 4, 9, 1000]
    assert df.select(text.bit_width(F.array_max("a"))).first()[0] == 10


def test_guards():
    assert guard("a tion er tion", 10, 0) == ["tion", "er", "tion"]
    for q, k, o in (("x" * (MAX_QUERY + 1), 10, 0), ("ab", 0, 0), ("ab", 10, 501), ("ab " * 17, 10, 0)):
        with pytest.raises(ValueError):
            guard(q, k, o)
