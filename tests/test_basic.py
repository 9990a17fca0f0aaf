import random

from pyspark.sql import functions as F

from tapeloom.functions import basic


def test_known_lines():
    assert basic.tokens('PRINT"HELLO PRINT":GOTO10') == b'\x99"HELLO PRINT":\x8910'
    assert basic.tokens("?A:REM FOR ?") == b"\x99A:\x8f FOR ?"
    assert basic.tokens('DATA FOR,"A:B",TO:PRINT') == b'\x83 FOR,"A:B",TO:\x99'
    assert basic.tokens("INPUT#1,A$:GO TO 5") == b"\x841,A$:\xcb \xa4 5"
    assert len(basic.KEYWORDS) == 76 and basic.CODES["GO"] == 0xCB


def test_listing_gives_the_text_back():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice([*basic.KEYWORDS, "A", " ", "1", ":", '"', ","]) for _ in range(rng.randrange(12)))
        assert basic.listed(basic.tokens(line)) == line


def brute_listing(text):
    """A listing by a walk over the characters, without bytes in between."""
    out, i, quoted, data = "", 0, False, False
    while i < len(text):
        c, word = text[i], None
        if not quoted and not data:
            word = max((k for k in basic.KEYWORDS if text.startswith(k, i)), key=len, default=None)
        if word == "REM":
            return out + "".join(x if ord(x) < 256 else "?" for x in text[i:])
        if word:
            out, i, data = out + word, i + len(word), word == "DATA"
            continue
        quoted ^= c == '"'
        data &= quoted or c != ":"
        out += "PRINT" if c == "?" and not quoted and not data else c if ord(c) < (256 if quoted else 128) else "?"
        i += 1
    return out


def test_all_turns_are_listed(spark, tmp_path):
    import hashlib

    from conftest import DATA

    from tapeloom.plans import catalogue

    rng = random.Random(4)
    odd = ["".join(rng.choice(["REM", "DATA", "PRINT", "FOR", "?", "é", "¿", "£", "日", "A", " ", ":", '"', "\n"]) for _ in range(rng.randrange(14))) for _ in range(600)]
    rows = [(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    kind = dict(spark.read.parquet(f"{DATA}/conversations.parquet").dtypes)
    rows += [(rows[0][0], 1000 + i, t) for i, t in enumerate(["¿Qué? £5", "日本?", "", None, *odd])]
    spark.createDataFrame(rows, f"conv_id {kind['conv_id']}, turn {kind['turn']}, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["program_listings_all"](spark, str(tmp_path)).collect()))
    assert got == sorted((c, n, hashlib.md5(brute_listing(t or "").encode()).hexdigest()) for c, n, t in rows)


def test_lines_are_linked(spark):
    df = spark.createDataFrame([("p", 20, "END"), ("p", 10, 'PRINT"HI"'), ("q", 5, None)], "p string, n int, t string")
    rows = {(r.p, r.n): r for r in basic.stored(df.filter("t is not null"), ["p"], "n", "t").collect()}
    first, second = rows["p", 10], rows["p", 20]
    assert (first.address, first.link, bytes(first.line)) == (2049, 2059, b'\x0b\x08\x0a\x00\x99"HI"\x00')
    assert (second.address, bytes(second.line)) == (2059, b"\x11\x08\x14\x00\x80\x00")
    back = df.select(basic.listed_of(basic.tokens_of(F.col("t"))).alias("t"))
    assert [r.t for r in back.collect()] == ["END", 'PRINT"HI"', None]
