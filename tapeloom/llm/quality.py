"""Quality rules: a linear-chain CRF labels the lines of a text as content or boilerplate.

The labeller has two states and sparse indicator features of a line (length, symbols, capitals, digits,
separators, repetition, end of sentence). It learns from a bounded sample of documents with a quality label, whose lines
have weak labels: first every line stands alone and takes its document's label, which tells the features of either kind;
then a line that these tell apart clearly takes what they say, and a line between takes its document's label. So a bad
document's clean lines and a good one's boilerplate count as what they are, sequences change state, and the chain's
weights, the maximum-likelihood ones of these labels, learn how often. Viterbi decoding gives the best label sequence of
each whole text; a document is kept when the content lines hold enough of its words.

Defined cases: a null or empty text has no words, fails the base rule (fewer than 20 words) and isn't kept.
Without labelled rows of both kinds the labeller calls every line content. Lines without a word aren't labelled.
Of equally good label sequences that wins which has content in the last line where they differ. A very long text is decoded whole, in time and memory
proportional to its lines. Repeated rows get equal verdicts; extra columns pass through, and a clash of names is solved by
a new name. An empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, tidy, trimmed

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Words in content lines, as a share of all words, from which a document is kept.
MIN_CONTENT_SHARE = 0.5
#: The labeller is fitted on at most so many documents of each label, cut into sequences of so many lines.
SAMPLE_DOCS = 1500
SEQUENCE_LINES = 64
SAMPLE_SEQUENCES = 6000
#: Log-odds from which a line's features outweigh its document's label.
CLEAR = 1.0

RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,n_lines:bigint,n_content_lines:bigint,content_share:double,kept:boolean>"
)

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = SYMBOLS.encode()
_LINK = re.compile(rb"https?://|www\.|@")
_BANG = re.compile(rb"!!")

#: (name, number of buckets) of each feature; a line switches on one bucket of each.
FEATURES = [("bias", 1), ("words", 6), ("symbols", 5), ("pipes", 3), ("bangs", 3), ("capitals", 4), ("digits", 4), ("repeated", 2), ("ended", 2), ("link", 2), ("long_words", 4)]
_OFFSETS = np.cumsum([0, *(n for _, n in FEATURES)])
N_FEATURES = int(_OFFSETS[-1])


def _bucket(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def line_features(line: bytes, n_words: int, repeated: bool) -> list[int]:
    """Indices of the indicators that a line switches on."""
    size = len(line)
    drop = lambda cut: size - len(line.translate(None, cut))
    symbols, upper, lower, digits = drop(_SYMBOLS), drop(_UPPER), drop(_LOWER), drop(_DIGITS)
    pipes, bangs = line.count(b"|"), len(_BANG.findall(line))
    values = (
        0,
        _bucket(n_words, (2, 4, 8, 16, 32)),
        _bucket(symbols / n_words, (0.02, 0.1, 0.5, 1.5)),
        _bucket(pipes / n_words, (0.01, 0.3)),
        _bucket(bangs / n_words, (0.01, 0.3)),
        _bucket(upper / max(1, upper + lower), (0.1, 0.3, 0.7)),
        _bucket(digits / size, (0.01, 0.1, 0.3)),
        int(repeated),
        int(line.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"')),
        int(bool(_LINK.search(line))),
        _bucket(size / n_words, (4, 8, 16)),
    )
    return [int(o) + v for o, v in zip(_OFFSETS, values, strict=False)]


def lines_of(text: str) -> Iterator[tuple[bytes, int, bool]]:
    """(line, number of words, whether an equal line stands before) of each line that has a word."""
    seen = set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if n := len(line.split()):
            yield line, n, line in seen
            seen.add(line)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words that the text holds at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    width = 1
    while width < window:  # ids of runs of 1, 2, 4 and 8 words; the window is a power of two
        pairs = ids[:-width] * (len(words) + 1) + ids[width:]
        ids = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass
class LineCrf:
    """Weights of a chain with the states 0 (content) and 1 (boilerplate)."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES, 2)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def viterbi(self, features: list[list[int]]) -> list[int]:
        """The best label sequence; of equal ones that with content in the last line where they differ."""
        if not features:
            return []
        scores = self.emit[np.array(features)].sum(1).tolist()
        (a00, a01), (a10, a11) = self.step.tolist()
        s0, s1 = self.start[0] + scores[0][0], self.start[1] + scores[0][1]
        back = []
        for e0, e1 in scores[1:]:
            from0, to1 = s0 + a00 >= s1 + a10, s0 + a01 >= s1 + a11
            back.append((0 if from0 else 1, 0 if to1 else 1))
            s0, s1 = (s0 + a00 if from0 else s1 + a10) + e0, (s0 + a01 if to1 else s1 + a11) + e1
        best = [0 if s0 >= s1 else 1]
        for b in reversed(back):
            best.append(b[best[-1]])
        return best[::-1]

    @classmethod
    def weak(cls, sequences: list[tuple[int, list[list[int]]]], clear: float = CLEAR) -> list[tuple[list[int], list[list[int]]]]:
        """Sequences of a document's state with a state for each line: what the line's features say if they are clear."""
        alone = cls.fit([([y], [x]) for y, lines in sequences for x in lines])
        out = []
        for y, lines in sequences:
            emit = alone.emit[np.array(lines)].sum(1) + alone.start
            odds = emit[:, 1] - emit[:, 0]
            out.append((np.where(np.abs(odds) > clear, odds > 0, y).astype(int).tolist(), lines))
        return out

    @classmethod
    def fit(cls, sequences: list[tuple[list[int], list[list[int]]]], rounds: int = 100, rate: float = 0.1, decay: float = 1e-3) -> LineCrf:
        """Maximum likelihood by Adam over all sequences at once; a sequence is the states of its lines and their features."""
        if len({y for states, _ in sequences for y in states}) < 2:
            return cls()
        n, t = len(sequences), max(len(x) for _, x in sequences)
        used = np.zeros((n, t), bool)
        x = np.zeros((n, t, len(FEATURES)), np.int64)
        y = np.zeros((n, t), np.int64)
        for i, (states, lines) in enumerate(sequences):
            used[i, : len(lines)], x[i, : len(lines)], y[i, : len(lines)] = True, lines, states
        sizes = [N_FEATURES * 2, 4, 2]
        w, m, v = (np.zeros(sum(sizes)) for _ in range(3))
        hot = np.eye(2)
        flat = x[used]
        for k in range(1, rounds + 1):
            emit, step, start = (p.reshape(s) for p, s in zip(np.split(w, np.cumsum(sizes)[:-1]), ((N_FEATURES, 2), (2, 2), (2,)), strict=True))
            e = np.zeros((n, t, 2))
            e[used] = emit[flat].sum(1)
            alpha = np.empty((n, t, 2))
            alpha[:, 0] = start + e[:, 0]
            for i in range(1, t):
                nxt = np.logaddexp(alpha[:, i - 1, :1] + step[0], alpha[:, i - 1, 1:] + step[1]) + e[:, i]
                alpha[:, i] = np.where(used[:, i, None], nxt, alpha[:, i - 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            beta = np.zeros((n, t, 2))
            g_step = np.zeros((2, 2))
            for i in range(t - 1, 0, -1):
                to = beta[:, i] + e[:, i]
                on = used[:, i]
                pair = np.exp(alpha[:, i - 1, :, None] + step[None] + to[:, None, :] - z[:, None, None])
                seen = hot[y[:, i - 1]][:, :, None] * hot[y[:, i]][:, None, :]
                g_step += ((pair - seen) * on[:, None, None]).sum(0)
                nxt = np.logaddexp(step[:, 0][None] + to[:, :1], step[:, 1][None] + to[:, 1:])
                beta[:, i - 1] = np.where(on[:, None], nxt, beta[:, i])
            node = np.exp(alpha + beta - z[:, None, None]) - hot[y]
            g_emit = np.zeros((N_FEATURES, 2))
            np.add.at(g_emit, flat, np.repeat(node[used][:, None], len(FEATURES), 1))
            g = np.concatenate([g_emit.ravel(), g_step.ravel(), node[:, 0].sum(0)]) / used.sum() + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        emit, step, start = np.split(w, np.cumsum(sizes)[:-1])
        return cls(emit.reshape(N_FEATURES, 2), step.reshape(2, 2), start)


def judge(text: str | None, crf: LineCrf, min_share: float = MIN_CONTENT_SHARE) -> dict:
    """The figures and the verdict of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = list(lines_of(text))
    labels = crf.viterbi([line_features(*x) for x in lines])
    repeats = repeated_words(words)
    content = sum(n for (_, n, _), y in zip(lines, labels, strict=True) if y == 0)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    share = content / len(words) if words else 0.0
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": sum(r for _, _, r in lines),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "n_lines": len(lines),
        "n_content_lines": labels.count(0),
        "content_share": share,
        "kept": not failed and share >= min_share,
    }


_ARROW = pa.struct([(n, pa.bool_() if n in ("base_failed", "kept") else pa.float64() if n == "content_share" else pa.int64()) for n in judge(None, LineCrf())])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_sequences: int = SAMPLE_SEQUENCES) -> LineCrf:
    """Fit the labeller on the sample_docs labelled documents of each quality that come first by a hash of doc_id.

    What comes to the driver is bounded by sample_sequences sequences of SEQUENCE_LINES lines, as small integers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = None
    for q in (0, 1):
        part = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        chosen = part if chosen is None else chosen.union(part)
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_docs rows
    width = len(FEATURES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for d, text, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = [line_features(*line) for line in lines_of(text)]
                for i in range(0, len(x), SEQUENCE_LINES):
                    for column, value in zip(out, (d, i, q, bytes(v for f in x[i : i + SEQUENCE_LINES] for v in f)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["doc_id", "at", "quality", "x"])

    rows = sample.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(tidy(cut), "doc_id long, at int, quality int, x binary")
    rows = rows.orderBy("at", F.xxhash64("doc_id"), "doc_id", "x").limit(sample_sequences).collect()
    return LineCrf.fit(LineCrf.weak([(1 - r.quality, np.frombuffer(r.x, np.uint8).reshape(-1, width).tolist()) for r in rows]))


def annotate(docs: DataFrame, crf: LineCrf, text: str = "text", out: str = "quality", min_share: float = MIN_CONTENT_SHARE) -> tuple[DataFrame, str]:
    """docs with a struct column of the figures and the verdict, and that column's name. No shuffle."""
    bounded_batches(docs.sparkSession)
    name = fresh(docs, out)

    @F.arrow_udf(RESULT)
    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array([judge(t, crf, min_share) for t in texts.to_pylist()], _ARROW)
        finally:
            trimmed()

    return docs.withColumn(name, verdicts(F.col(text))), name
