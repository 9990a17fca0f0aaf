"""Language identification by compression: the language whose zstandard dictionary shrinks a text most.

Every learned language gets a raw-content dictionary, made of a bounded, hash-chosen sample of pieces of labelled
texts. A text is lower-cased, its runs of other characters
than letters become one space, it is cut into blocks, every block is compressed with each dictionary, and the sizes of all its blocks are
summed, so that each part of a long text counts alike. The smallest total wins (a tie goes to the language with
more learned rows, then to the name that sorts first). The score is the winner's share of exp(-size difference per byte), and a text is rejected when the saving
against the runner-up is below MIN_MARGIN of the winner's size.

Defined cases: a text that is null or has no letter gives `und`, score 0 and a rejection; so does every text when
no language was learned. With one learned language that language wins with score 1. Repeated rows get equal results. A
very long text is compressed block by block, in one row. A column name that docs already has is avoided by a new name, and
an empty table stays empty. Learned languages are counted on the driver, and each has a dictionary that is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, trimmed

UNKNOWN = "und"
#: Size of a dictionary, the length of its pieces, and the most labelled rows asked for it.
DICTIONARY_BYTES = 96 << 10
PIECE_CHARS = 200
SAMPLE_DOCS = 600
BLOCK_BYTES = 4096
LEVEL = 6
#: A text is rejected when the runner-up is less than this share larger.
MIN_MARGIN = 0.002
#: Sharpness of the score: nats for a difference of one byte in a byte of compressed text.
SHARPNESS = 60.0

RESULT = "struct<lang_pred:string,score:double,margin:double,kept:boolean>"
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("kept", pa.bool_())])
_OTHERS = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    """The lower-cased letters of a text in UTF-8, its other characters as single spaces."""
    return _OTHERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """A dictionary for each language, from about sample_docs rows of it (twice as many at most), chosen by a hash of key.

    One pass counts the rows of each language; a second keeps one piece of PIECE_CHARS characters of the chosen rows."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return {}
    spread = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(spread))
    shares = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(spread, spread * sample_docs // n))))
    start = F.pmod(F.xxhash64(F.col(key)), F.greatest(F.lit(1), F.length(text) - PIECE_CHARS)) + 1
    pieces = rows.filter(draw < shares[F.col(lang)]).select(F.col(lang).alias("l"), draw.alias("h"), F.col(text).substr(start.cast("int"), F.lit(PIECE_CHARS)).alias("piece"))
    taken: dict[str, list[str]] = {}
    for r in pieces.orderBy("h", "piece").limit(2 * sample_docs * len(counts)).collect():
        taken.setdefault(r.l, []).append(r.piece)
    return {k: b" ".join(map(letters, v))[-DICTIONARY_BYTES:] for k, v in sorted(taken.items(), key=lambda x: (-counts[x[0]], x[0]))}


class Compressors:
    """The compressors of all languages, built once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.each = []
        for name in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, whether the text is kept)."""
        raw = letters(text or "")
        if not self.langs or not raw:
            return UNKNOWN, 0.0, 0.0, False
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.each]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0, True
        margin = (min(s for i, s in enumerate(sizes) if i != best) - sizes[best]) / sizes[best]
        score = 1 / sum(math.exp(-SHARPNESS * (s - sizes[best]) / sizes[best]) for s in sizes)
        return self.langs[best], score, margin, margin >= MIN_MARGIN


def annotate(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", out: str = "language") -> tuple[DataFrame, str]:
    """docs with a struct column of language, score, margin and verdict, and that column's name. No shuffle.

    The dictionaries are broadcast: DICTIONARY_BYTES for each learned language."""
    bounded_batches(docs.sparkSession)
    name = fresh(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf(RESULT)
    def languages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Compressors(shared.value)
        try:
            for texts in batches:
                columns = zip(*(known.predict(t) for t in texts.to_pylist()), strict=True) if len(texts) else ([], [], [], [])
                yield pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], fields=list(_ARROW))
        finally:
            del known
            trimmed()

    return docs.withColumn(name, languages(F.col(text))), name
