"""License scans with ordered signature rules.

Texts are reduced to words (ASCII letters lower-cased; anything from U+0080 on is part of a word) that are
joined by single spaces. A keyword automaton says which rules can match at all; only those rules' regular
expressions run. Overlapping detections are resolved in the order of priority, then length: one that lies
within a detection that was already kept is suppressed. The base phrases always stay.

The rules are written by hand, one a line, in ``license_rules``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of
from .license_rules import FORMS, KINDS, RULES

#: Bytes that are not part of a word become spaces and A-Z become a-z, in one step.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: The base phrases.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    strength: float


def parse_rules(lines: str = RULES) -> list[Rule]:
    """The rules of a table of lines, in their order."""
    out = []
    for line in lines.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        label, kind, keyword, body = (x.strip() for x in line.split(" | ", 3))
        body = re.sub("<([a-z]+)>", lambda m: FORMS[m[1]], body)
        priority, strength = KINDS[kind]
        out.append(Rule(label, priority, keyword, re.compile(f"(?<![^ ])(?:{body})(?![^ ])"), strength))
    return out


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules: dict[str, list[Rule]] = {}
        for rule in parse_rules():
            self.rules.setdefault(rule.keyword, []).append(rule)
        self.gate = ahocorasick.Automaton()
        for keyword in self.rules:
            self.gate.add_word(f" {keyword}", keyword)
        self.gate.make_automaton()

    def __call__(self, text: str | None) -> dict:
        """Words, base places and kept detections of a text; places are counted in words from 0."""
        words = (text or "").encode().translate(_TABLE).split()
        joined = " " + b" ".join(words).decode() + " "
        base: list[tuple[int, int, str]] = []
        for phrase, label in BASE:
            at = joined.find(f" {phrase} ")
            while at >= 0:
                base.append((at + 1, at + 1 + len(phrase), label))
                at = joined.find(f" {phrase} ", at + 1)
        hits = []
        for keyword in {k for _, k in self.gate.iter(joined)}:
            for rule in self.rules[keyword]:
                hits += [(rule.priority, m.end() - m.start(), m.start(), m.end(), rule.label, rule.strength) for m in rule.pattern.finditer(joined)]
        hits.sort(key=lambda h: (-h[0], -h[1], h[2], h[4]))
        kept: list[tuple[int, int, str, float]] = []
        places = sorted({h[2] for h in hits})
        reach = [0] * (len(places) + 1)  # a Fenwick tree: the furthest end of what was kept up to a start
        for _, _, lo, hi, label, strength in hits:
            i = at = bisect_left(places, lo) + 1
            far = 0
            while i:
                far = max(far, reach[i])
                i &= i - 1
            if far < hi:
                kept.append((lo, hi, label, strength))
                while at < len(reach):
                    reach[at] = max(reach[at], hi)
                    at += at & -at
        begins = [*accumulate((len(w) + 1 for w in joined[1:-1].split(" ")), initial=1)] if base or kept else []
        nth = lambda place: bisect_left(begins, place)
        starts = sorted(nth(lo) for lo, _, _ in base)
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": starts[0] if starts else None,
            "last_word": starts[-1] if starts else None,
            "base_labels": ",".join(sorted({x[2] for x in base})),
            "labels": ",".join(sorted({x[2] for x in base} | {x[2] for x in kept})),
            "score": 1.0 if base else max((x[3] for x in kept), default=0.0),
            "detections": [{"label": x[2], "first": nth(x[0]), "last": nth(x[1]) - 1} for x in sorted(kept)],
        }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first:long,last:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: counts, base places, labels, score (0: no sign of a license) and detections.

    Null and empty texts have no words. Repeated rows and null ids stay; other columns are ignored.
    """

    def make():
        look = Scanner()

        def each(batch: pa.RecordBatch) -> dict:
            found = [look(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0)} | {k: [f[k] for f in found] for k in (found[0] if found else ())}

        return each

    return map_batches(texts_of(docs, id_col, text_col), make, SCHEMA)
