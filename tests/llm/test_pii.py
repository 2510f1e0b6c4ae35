"""Added kinds of personal data: what counts, what does not, and the digest against a plain one."""

from __future__ import annotations

import hashlib

import pytest

from siltmill.llm import pii


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Taking into account 100000 users", []),
        ("accounted for 1234567 units", []),
        ("account 2019-2020 report", []),
        ("routing table 192168 entries", []),
        ("token: embedding layer", []),
        ("tokens: abc123456", []),
        ("the secret: patience", []),
        ("paraccount no 12345678", []),
        ("routing number 021000022", []),
        ("SSN 000-12-3456", []),
        ("DE89370400440532013001", []),
        ("xDE89370400440532013000", []),
        ("send to DE89370400440532013000 now", ["account:DE89370400440532013000"]),
        ("IBAN GB82 WEST 1234 5698 7654 32.", ["account:GB82 WEST 1234 5698 7654 32"]),
        ("API Key = abcdef123", ["secret:abcdef123"]),
        ("Api key: 'Zk3-99aPq'", ["secret:Zk3-99aPq"]),
        ("db_PASSWORD=hunter2x;", ["secret:hunter2x"]),
        ('token = "embedding"', ["secret:embedding"]),
        ("Account No. 1234567", ["account:1234567"]),
        ("account 123456789 was closed", ["account:123456789"]),
        ("Routing number: 021000021", ["account:021000021"]),
        ("social security number 219-09-9999", ["account:219-09-9999"]),
        ("Passport No: X1234567", ["account:X1234567"]),
        ("see HTTPS://a.b/c?d=e, and", ["url:HTTPS://a.b/c?d=e"]),
        ("İİ Password = q1w2e3r4", ["secret:q1w2e3r4"]),
    ],
)
def test_added_kinds(text, want):
    got = [f"{k}:{text[a:b]}" for k, a, b in pii.find(text, pii.automaton()) if k not in pii.BASE]
    assert got == want


def test_digest_is_plain(docs, small):
    auto = pii.automaton()
    for table in (docs, small):
        want = []
        for r in table.select("doc_id", "text").collect():
            spans = sorted(pii.find(r[1], auto), key=lambda s: (s[1], pii.KINDS.index(s[0])))
            said = lambda kinds, spans=spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in kinds)
            want.append((r[0], *[sum(s[0] == k for s in spans) for k in pii.BASE], hashlib.sha256(said(pii.BASE).encode()).hexdigest(), said(pii.KINDS)))
        got = [tuple(r) for r in pii.digest(pii.pii_spans(table)).collect()]
        order = lambda x: (x[0] is None, x[0] or 0, x[-1])
        assert sorted(got, key=order) == sorted(want, key=order)


def test_redaction_keeps_clashing_columns(spark):
    table = spark.createDataFrame([(1, "a@b.cd", "x"), (2, None, None)], "doc_id long, text string, redacted string")
    assert {tuple(r) for r in pii.redacted(table).collect()} == {(1, "[email]", "x"), (2, None, None)}
