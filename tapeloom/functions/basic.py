"""Lines of a stored BASIC program: keywords as one byte, and back to text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.binary import packed
from tapeloom.operators.sequences import running_start

#: The keywords in the order of their tokens, from 128 on.
KEYWORDS = (
    "END FOR NEXT DATA INPUT# INPUT DIM READ LET GOTO RUN IF RESTORE GOSUB RETURN REM STOP ON WAIT LOAD SAVE VERIFY DEF POKE PRINT# PRINT CONT LIST CLR CMD SYS OPEN CLOSE GET NEW "
    "TAB( TO FN SPC( THEN NOT STEP + - * / ^ AND OR > = < SGN INT ABS USR FRE POS SQR RND LOG EXP COS SIN TAN ATN PEEK LEN STR$ VAL ASC CHR$ LEFT$ RIGHT$ MID$ GO"
).split()
CODES = {k: 128 + i for i, k in enumerate(KEYWORDS)}
BASE = 2049
_PART = re.compile(r'(?P<text>"[^"]*"?)|(?P<rest>REM.*)|(?P<data>DATA(?:[^:"]|"[^"]*"?)*)|(?P<print>\?)|(?P<word>' + "|".join(re.escape(k) for k in sorted(KEYWORDS, key=len, reverse=True)) + ")|(?P<other>.)", re.DOTALL)


_QUOTED = re.compile(r'("[^"]*"?)')


def _plain(part: str) -> bytes:
    """Bytes as they stand. Outside quotes a byte from 128 on would be listed as a keyword, so only ASCII has bytes there."""
    return b"".join(x.encode("latin-1" if x[:1] == '"' else "ascii", "replace") for x in _QUOTED.split(part))


def tokens(line: str) -> bytes:
    """The line's bytes: keywords outside quotes, longest first; after REM all, after DATA up to a colon is as it stands.

    A character without a byte is stored as a question mark: beyond Latin-1 in quotes and after REM, beyond ASCII elsewhere."""
    out = bytearray()
    for m in _PART.finditer(line):
        kind, part = m.lastgroup, m[0]
        if kind == "word":
            out.append(CODES[part])
        elif kind == "print":
            out.append(CODES["PRINT"])
        elif kind in ("rest", "data"):
            word = "REM" if kind == "rest" else "DATA"
            out.append(CODES[word])
            out += part[len(word) :].encode("latin-1", "replace") if kind == "rest" else _plain(part[len(word) :])
        else:
            out += _plain(part)
    return bytes(out)


def listed(raw: bytes) -> str:
    """The text of a stored line. Bytes from 128 on are keywords unless they stand in quotes or after REM."""
    out, quoted, remark = [], False, False
    for b in raw:
        quoted ^= b == 34
        if b >= 128 and not quoted and not remark and b - 128 < len(KEYWORDS):
            out.append(KEYWORDS[b - 128])
            remark = b == CODES["REM"]
        else:
            out.append(chr(b))
    return "".join(out)


@F.arrow_udf(T.BinaryType())
def tokens_of(lines: pa.Array) -> pa.Array:
    return pa.array([None if t is None else tokens(t) for t in lines.to_pylist()], pa.binary())


@F.arrow_udf(T.StringType())
def listed_of(lines: pa.Array) -> pa.Array:
    return pa.array([None if b is None else listed(b) for b in lines.to_pylist()], pa.string())


def stored(lines: DataFrame, keys: list[str], number: str, text: str) -> DataFrame:
    """(keys, number, address, link, line): a program's lines with their links; link, number, tokens and a zero make a line."""
    body = lines.select(*keys, number, tokens_of(F.col(text)).alias("_body"))
    placed = running_start(body, keys, [number], F.octet_length("_body") + 5, "address", BASE)
    link = F.col("address") + F.octet_length("_body") + 5
    raw = F.concat(packed(link % 65536, 2), packed(F.col(number) % 65536, 2), F.col("_body"), F.lit(b"\0"))
    return placed.select(*keys, number, F.col("address").cast("long").alias("address"), link.cast("long").alias("link"), raw.alias("line"))
