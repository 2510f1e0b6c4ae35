"""Product titles derived from an id, a brand and a category."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and their weights.
COLORS = (("black", 22), ("white", 18), ("silver", 14), ("grey", 11), ("blue", 9), ("red", 7), ("gold", 5), ("green", 4), ("beige", 3), ("rose", 2), ("copper", 1))
MODIFIERS = (("classic", 20), ("compact", 16), ("premium", 13), ("portable", 10), ("wireless", 8), ("essential", 7), ("lite", 5), ("pro", 4), ("max", 3), ("eco", 2), ("ultra", 1))


def title_case(text: Column) -> Column:
    """A capital after everything that is no letter, small letters elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def _digest(product: Column, salt: str) -> Column:
    return F.crc32(F.concat(product, F.lit(salt)).cast("binary"))


def weighted_word(words: tuple[tuple[str, int], ...], digest: Column) -> Column:
    """The word whose share of the weights a hash falls into."""
    ends = list(accumulate(w for _, w in words))
    place = digest % ends[-1]
    pick = None
    for (word, _), end in zip(words, ends, strict=True):
        pick = (F if pick is None else pick).when(place < end, word.capitalize())
    return pick


def model_code(digest: Column) -> Column:
    """A letter and three digits."""
    letter = F.expr("'ABCDEFGHIJKLMNOPQRSTUVWXYZ'").substr((digest % 26 + 1).cast("int"), F.lit(1))
    return F.concat(letter, F.lpad((F.floor(digest / 26) % 1000).cast("string"), 3, "0"))


def category_leaf(category: Column) -> Column:
    return F.trim(F.replace(F.element_at(F.split(category, r"\."), -1), F.lit("_"), F.lit(" ")))


def derive_title(product: Column, brand: Column, category: Column) -> Column:
    """Brand, color, modifier, category leaf and code; null if there is neither brand nor leaf, or no product."""
    leaf = F.nullif(category_leaf(category), F.lit(""))
    named = F.nullif(brand, F.lit(""))
    words = F.concat_ws(
        " ",
        title_case(F.trim(named)),
        weighted_word(COLORS, _digest(product, "color")),
        weighted_word(MODIFIERS, _digest(product, "modifier")),
        title_case(leaf),
        model_code(_digest(product, "model")),
    )
    return F.when(product.isNotNull() & (named.isNotNull() | leaf.isNotNull()), words)
