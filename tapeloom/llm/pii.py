"""PII by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers expand and check the boundaries.

One pass of the automaton over the whole text finds at-signs, plus signs, digits, scheme marks and identifier cues.
Each anchor is handed to a deterministic parser that looks at the text around it only:

- email: `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, expanded to both sides of the at-sign
- ip: four groups of digits joined by dots, each at most 255
- card: 16 to 19 digits, single spaces or hyphens between them allowed, with a right Luhn digit
- phone: `\\+[0-9][\\x20().0-9-]+[0-9]` with 8 to 15 digits
- secret: the value after a cue such as `token =`, 8 characters at least; cues count in any case, but not inside a word
- account: after a cue such as `account no.` 6 to 34 letters and digits with 6 digits; an IBAN needs a right check number
- login: the `user:password` of an address with a scheme

The first four are found leftmost and non-overlapping within their kind; a candidate that fails its check is dropped
and not tried again from within. Spans of different kinds may overlap. Positions are code points, the end exclusive.

Defined cases: a null or empty text has no spans, and an empty table stays empty. Repeated rows get equal spans. Every parser is linear in the run
that it looks at, so texts of any length pass. A column name that docs already has is avoided by a new name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, trimmed

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "login")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key")
ACCOUNT_CUES = ("account", "acct", "iban")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"""[ \t]{0,3}[=:][ \t]{0,3}["']?([A-Za-z0-9+/_.=-]{8,})""")
_ACCOUNT = re.compile(r"(?:[ ]?(?:no|nr|number|id)\.?)?[ ]?[:=#]?[ ]?([A-Z]{0,2}[0-9][A-Z0-9]{5,31}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.I)
_SMALL = {c: c + 32 for c in range(65, 91)}
_LOGIN = re.compile(r"([^\s/@:]{1,64}:[^\s/@]{1,128})@[A-Za-z0-9]")


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in "@+0123456789":
        found.add_word(mark, ("email" if mark == "@" else "phone" if mark == "+" else "digit", 1))
    found.add_word("://", ("login", 3))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a whole text, by kind as listed in KINDS, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys((*KINDS, "digit"), 0)  # where the next candidate of a kind may start
    small = text.lower()
    if len(small) != len(text):  # the small form of a letter may be two characters
        small = text.translate(_SMALL)
    for last, (kind, width) in anchors().iter(small):
        at = last - width + 1
        if kind == "digit":
            if at >= after["card"]:
                m = _CARD.match(text, at)
                after["card"] = m.end() if m else at + 1
                if m and 16 <= m.end() - at <= 37:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
            if at >= after["ip"]:
                m = _DOTTED.match(text, at)
                after["ip"] = m.end()
                if "." in m[0]:
                    parts = list(_PART.finditer(text, at, m.end()))
                    for i in range(0, len(parts) - 3, 4):
                        if all(_small(p[0]) for p in parts[i : i + 4]):
                            found["ip"].append((parts[i].start(), parts[i + 3].end()))
        elif kind == "phone":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                after["phone"] = m.end()
                if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                    found["phone"].append(m.span())
        elif kind == "email":
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                found["email"].append((start, m.end()))
        else:
            end = last + 1
            if kind != "login" and at and text[at - 1].isalnum():
                continue  # a cue is a word, or follows a mark as in access_token
            m = (_SECRET if kind == "secret" else _ACCOUNT if kind == "account" else _LOGIN).match(text, end)
            if not m or m.start(1) < after[kind]:
                continue
            if kind == "account":
                value = m[1].replace(" ", "").upper()
                checked = value[:2].isalpha() and value[2:4].isdigit()
                if sum(c.isdigit() for c in value) < 6 or checked and not iban(value):
                    continue
            after[kind] = m.end(1)
            found[kind].append(m.span(1))
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def redact(text: str, marked: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by `<KIND>`, the kind of its first and longest span."""
    out, done = [], 0
    for kind, start, end in sorted(marked, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@F.arrow_udf(SPANS)
def spans_of(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in texts.to_pylist()], _ARROW)


@F.arrow_udf(T.StringType())
def redacted_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    try:
        for texts in batches:
            yield pa.array([redact(t, s) if t and (s := spans(t)) else t for t in texts.to_pylist()], pa.string())
    finally:
        trimmed()


def annotate(docs: DataFrame, text: str = "text", out: str = "pii") -> tuple[DataFrame, str]:
    """docs with an array column of all spans, and that column's name. No shuffle."""
    bounded_batches(docs.sparkSession)
    name = fresh(docs, out)
    return docs.withColumn(name, spans_of(F.col(text))), name


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans of its text replaced by their kinds. No shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, redacted_of(F.col(text)))


def joined(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined in their order."""
    chosen = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
