"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a whole text: at-signs, plus signs, digits, schemes and identifier
cues. From each anchor a small deterministic parser expands to the left and right and validates what it has.
No regular expression runs over the text.

Base kinds, leftmost and non-overlapping within their kind, exactly as these expressions would match them:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, every part at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits

A match that fails its check is dropped and not retried. Added kinds, none of which starts inside a word:

* url: a scheme and what follows it up to white space or a quote
* account: an IBAN wherever it stands (its country's length, and 97 as modulus), or a number after a cue such as
  ``account no.``, held to the form its cue calls for
* secret: a value after a cue and a sign of assignment, as in ``API key = ...``; after a colon, or without quotes,
  plain words are no secrets

Cues count in any casing. Added spans may overlap base ones; base ones always stay.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, free_name, map_batches, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

# Anchors. An account's cue says which form its number must have.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "sftp://")
ACCOUNT_CUES = {
    "account": "number", "acct": "number", "a/c": "number", "kontonummer": "number", "sort code": "sort code", "routing": "routing", "aba": "routing", "iban": "iban",
    "passport": "document", "licence": "document", "license": "document", "ssn": "ssn", "social security": "ssn",
}
SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "token", "api_key", "api-key", "apikey", "api key", "secret", "secret_key", "access_key", "access key", "private_key", "private key", "client_secret")
#: Words that may stand between an account's cue and its number, the longest first; only they make short numbers count.
NUMBER_WORDS = ("numbers", "number", "num", "no", "nr", "id", "code")

# The length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`{}|\\^")
_VALUE_END = frozenset(" \t\n\r\x0b\x0c\"'`,;<>()[]{}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    """The modulus-97 check of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def automaton():
    """Anchors over a text in lower case: sign or kind, length, and for accounts the form of the number."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789"):
        a.add_word(word, (word if word in "@+" else "0", len(word), ""))
    for word in SCHEMES:
        a.add_word(word, ("url", len(word), ""))
    for word, form in ACCOUNT_CUES.items():
        a.add_word(word, ("account", len(word), form))
    for word in SECRET_CUES:
        a.add_word(word, ("secret", len(word), ""))
    a.make_automaton()
    return a


_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """A to Z in lower case, everything at its place."""
    low = text.lower()
    # Only some letters beyond ASCII change their number of characters.
    return low if len(low) == len(text) else text.translate(_LOWER)


def _email(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expands an at-sign; floor: where the last email ended."""
    lo = at
    while lo > floor and t[lo - 1] in _LOCAL:
        lo -= 1
    if lo == at:
        return None
    end, n, labels = at + 1, len(t), 0
    while True:
        stop = end
        while stop < n and t[stop] in _LABEL:
            stop += 1
        if stop == end:  # no label here: the dot before it is not part of the match
            end -= labels > 0
            break
        labels, end = labels + 1, stop
        if end < n and t[end] == ".":
            end += 1
        else:
            break
    return (lo, end) if labels >= 2 else None


def _ip(t: str, lo: int) -> tuple[int, int, bool] | None:
    """Four runs of digits joined by dots from lo; whether they are in range."""
    n, end, parts = len(t), lo, []
    for k in range(4):
        if k:
            if end >= n or t[end] != ".":
                return None
            end += 1
        start = end
        while end < n and t[end] in _DIGITS:
            end += 1
        if start == end:
            return None
        parts.append(t[start:end])
    return lo, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _card(t: str, lo: int) -> tuple[int, str]:
    """The end of the run of digits, single spaces and hyphens between them from lo, and its digits."""
    n, end = len(t), lo + 1
    while end < n:
        if t[end] in _DIGITS:
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end, t[lo:end].replace(" ", "").replace("-", "")


def _phone(t: str, plus: int) -> tuple[int, int, str] | None:
    n = len(t)
    if plus + 1 >= n or t[plus + 1] not in _DIGITS:
        return None
    end = plus + 2
    while end < n and t[end] in _PHONE:
        end += 1
    while end > plus + 3 and t[end - 1] not in _DIGITS:
        end -= 1
    if end < plus + 4 or t[end - 1] not in _DIGITS:
        return None
    return plus, end, "".join(c for c in t[plus:end] if c in _DIGITS)


def _url(t: str, lo: int, body: int) -> tuple[int, int] | None:
    end, n = body, len(t)
    while end < n and t[end] not in _URL_END:
        end += 1
    while end > body and t[end - 1] in ".,;:!?)]":
        end -= 1
    return (lo, end) if end > body else None


def _free(t: str, lo: int) -> bool:
    """No letter or digit stands before lo."""
    return lo == 0 or not t[lo - 1].isalnum()


def _iban(t: str, lo: int) -> tuple[int, int] | None:
    """An IBAN from its country's letters, in one piece or with single spaces."""
    size, n = IBAN_LENGTH.get(t[lo : lo + 2].upper()), len(t)
    if size is None or not _free(t, lo):
        return None
    body, i = "", lo
    while i < n and len(body) < size:
        if t[i] in _ALNUM:
            body += t[i]
        elif not (t[i] == " " and i > lo and t[i - 1] in _ALNUM):
            return None
        i += 1
    if len(body) < size or (i < n and t[i].isalnum()) or body[2] not in _DIGITS or body[3] not in _DIGITS:
        return None
    return (lo, i) if iban_ok(body.upper()) else None


def _account(t: str, low: str, end: int, form: str) -> tuple[int, int] | None:
    """The number after an account's cue, if it has the cue's form."""
    n, i, marked = len(t), end, False
    if i < n and t[i].isalnum():  # the cue goes on as another word
        return None
    while i < n:
        if t[i] in " \t":
            i += 1
        elif t[i] in ":#=.":
            marked, i = True, i + 1
        elif word := next((w for w in NUMBER_WORDS if low.startswith(w, i) and not low[i + len(w) : i + len(w) + 1].isalnum()), None):
            marked, i = True, i + len(word)
        else:
            break
        if i > end + 24:
            return None
    if i >= n or t[i] not in _ALNUM or (i == end):
        return None
    if got := _iban(t, i):
        return got
    if form == "document":
        stop = i
        while stop < n and t[stop] in _ALNUM:
            stop += 1
        digits = sum(c in _DIGITS for c in t[i:stop])
        return (i, stop) if marked and 6 <= stop - i <= 16 and digits >= 5 else None
    if t[i] not in _DIGITS:
        return None
    stop, digits = _card(t, i)
    if stop < n and t[stop].isalnum():
        return None
    whole = stop - i == len(digits)
    if form == "ssn":
        ok = len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    elif form == "routing":
        ok = whole and len(digits) == 9 and sum(int(d) * (3, 7, 1)[k % 3] for k, d in enumerate(digits)) % 10 == 0
    elif form == "sort code":
        ok = len(digits) == 6
    elif form == "iban":
        ok = False
    else:
        # Without a word or sign that says so, only a long number in one piece is an account's.
        ok = 6 <= len(digits) <= 18 if marked else whole and 8 <= len(digits) <= 18
    return (i, stop) if ok else None


def _secret(t: str, end: int) -> tuple[int, int] | None:
    """The value after a cue and a sign of assignment."""
    n, i = len(t), end
    while i < n and t[i] in " \t\"'":
        i += 1
    if i >= n or t[i] not in "=:":
        return None
    sign, i = t[i], i + 1
    while i < n and t[i] in "=>":
        i += 1
    quoted = False
    while i < n and t[i] in " \t\"'":
        quoted |= t[i] in "\"'"
        i += 1
    stop = i
    while stop < n and t[stop] not in _VALUE_END:
        stop += 1
    value = t[i:stop].rstrip(".!?")
    plain = value.isalpha() and (value.islower() or value[1:].islower())
    return (i, i + len(value)) if len(value) >= 6 and not (plain and (sign == ":" or not quoted)) else None


def find(text: str | None, auto) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind in the order of KINDS; code points, end exclusive."""
    if not text:
        return []
    spans: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, whether it passed or not
    t, n, low = text, len(text), lowered(text)
    for last, (what, size, form) in auto.iter(low):
        lo = last + 1 - size
        if what == "0":
            if lo >= 2 and t[lo - 1].isalpha() and lo >= done["account"] and t[lo - 2].isalpha() and (got := _iban(t, lo - 2)):
                done["account"] = got[1]
                spans.append((got[0], KINDS.index("account"), got[1]))
            if lo >= done["card"]:
                end, digits = _card(t, lo)
                if end - lo > 1:
                    done["card"] = end
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append((lo, 2, end))
                else:
                    done["card"] = end
            # Only the first digit of a run can start an ip, or the first after the last one's end.
            if lo >= done["ip"] and (lo == done["ip"] or t[lo - 1] not in _DIGITS):
                stop = lo
                while stop < n and t[stop] in _DIGITS:
                    stop += 1
                if stop < n and t[stop] == "." and (got := _ip(t, lo)):
                    done["ip"] = got[1]
                    if got[2]:
                        spans.append((lo, 1, got[1]))
        elif what == "@":
            if got := _email(t, lo, done["email"]):
                done["email"] = got[1]
                spans.append((got[0], 0, got[1]))
        elif what == "+":
            if lo >= done["phone"] and (got := _phone(t, lo)):
                done["phone"] = got[1]
                if 10 <= len(got[2]) <= 15:
                    spans.append((lo, 3, got[1]))
        elif lo >= done[what] and _free(t, lo):
            got = _url(t, lo, last + 1) if what == "url" else _account(t, low, last + 1, form) if what == "account" else _secret(t, last + 1)
            if got:
                done[what] = got[1]
                spans.append((got[0], KINDS.index(what), got[1]))
    spans.sort()
    return [(KINDS[k], lo, hi) for lo, k, hi in spans]


def redact(text: str | None, auto) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    spans = find(text, auto)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, lo, hi = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < hi:
            hi = max(hi, spans[i][2])
            i += 1
        out += [text[at:lo], f"[{kind}]"]
        at = hi
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), for each row. Null and empty texts have none."""

    def make():
        auto = automaton()

        def each(batch: pa.RecordBatch) -> dict:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, auto)] for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "spans": found}

        return each

    return map_batches(texts_of(docs, id_col, text_col), make, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digest(spans: DataFrame) -> DataFrame:
    """The counts, the base spans' SHA-256 and all spans as text."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    base = of(BASE)
    return spans.select(
        "doc_id",
        *[F.size(of((k,))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in its text replaced; every row and column stays, null texts stay null."""

    def make():
        auto = automaton()
        return lambda texts: {new: [redact(t, auto) for t in texts]}

    new = free_name(docs, "redacted")
    out = append_columns(docs, text_col, make, f"`{new}` string")
    return out.withColumn(text_col, F.col(new)).drop(new)
