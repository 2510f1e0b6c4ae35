"""License rules: samples of every rule pass their own prefilter, and kept detections are those of a plain search."""

from __future__ import annotations

import itertools
import re
from re import _constants as c
from re import _parser

import numpy as np
import pytest

from siltmill.llm import licenses
from siltmill.llm.license_rules import FORMS, KINDS, RULES


def samples(tree, most=40):
    """Texts that a parsed expression matches: every branch, both ends of every repeat."""
    ways = []
    for op, arg in tree:
        if op is c.LITERAL:
            ways.append([chr(arg)])
        elif op is c.NOT_LITERAL:
            ways.append(["x"])
        elif op is c.IN:
            ways.append([chr(v) for o, v in arg if o is c.LITERAL] or ["x"])
        elif op is c.BRANCH:
            ways.append([s for branch in arg[1] for s in samples(branch, most)])
        elif op is c.SUBPATTERN:
            ways.append(samples(arg[3], most))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, body = arg
            inner = samples(body, most)
            ways.append([s * n for n in {low, min(high, low + 1)} for s in inner])
        elif op is c.ASSERT_NOT:
            ways.append([""])
        else:
            raise AssertionError(op)
    return list(itertools.islice(("".join(x) for x in itertools.product(*ways)), most))


def test_every_rule_can_run():
    look = licenses.Scanner()
    rules = licenses.parse_rules()
    assert len(rules) > 300 and len({(r.label, r.pattern.pattern) for r in rules}) == len(rules)
    for rule in rules:
        found = samples(_parser.parse(rule.pattern.pattern))
        assert found, rule
        for text in found:
            assert rule.pattern.fullmatch(text), (rule, text)
            assert any(w.startswith(rule.keyword) for w in text.split(" ")), (rule, text)
            got = look(text)
            assert got["labels"] and got["score"] > 0, (rule, text)


def test_forms_and_kinds_are_used():
    lines = [x for x in RULES.splitlines() if x.strip() and not x.startswith("#")]
    assert {x.split(" | ")[1] for x in lines} == set(KINDS)
    assert all(f"<{f}>" in RULES for f in FORMS)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2-or-later"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1-or-later"),
        ("GNU General Public License as published by the FSF; either version 3 of the License, or (at your option) any later version.", "gpl-3-or-later"),
        ("Licensed under GPLv3.", "gpl-3"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("This work is licensed under the GNU General Public License.", "gpl"),
        ("GPL v2 or later", "gpl-2-or-later"),
        ("Apache 2.0 license", "apache-2"),
        ("licensed under the Expat License", "mit"),
        ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
        ("do cc by the way, mitten and gnu", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ],
)
def test_notices(text, labels):
    assert licenses.Scanner()(text)["labels"] == labels


def plain(text, rules):
    """All rules without a prefilter, and suppression by comparing every pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text))
    joined = " " + " ".join(words) + " "
    hits = sorted(((r.priority, m.end() - m.start(), m.start(), m.end(), r.label) for r in rules for m in r.pattern.finditer(joined)), key=lambda h: (-h[0], -h[1], h[2], h[4]))
    kept = []
    for h in hits:
        if not any(k[2] <= h[2] and h[3] <= k[3] for k in kept):
            kept.append(h)
    nth = lambda place: joined[:place].count(" ") - 1
    return sorted((nth(h[2]), nth(h[3]), h[4]) for h in kept)


def test_suppression_is_brute_force():
    rules, look = licenses.parse_rules(), licenses.Scanner()
    rng = np.random.default_rng(8)
    parts = [s for r in rules for s in samples(_parser.parse(r.pattern.pattern), 3)] + ["or later", "version 2", "gnu", "cc by", "words between", "mit license 2 0"]
    for _ in range(300):
        text = " ".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(1, 9))))
        text = text.replace(" ", "-", 1).title()
        got = look(text)
        assert sorted((d["first"], d["last"], d["label"]) for d in got["detections"]) == plain(text, rules), text
