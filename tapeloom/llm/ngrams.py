"""LM scoring: stupid-backoff bigram scores from the whole corpus, by joins of n-gram tables.

Every word has its own count. The words with the highest counts, at most VOCABULARY of them (all words of a count or
none), are numbered and broadcast; all others are rare words, which stand for themselves as hashes of 62 bits. A
caller's own limit makes a closed vocabulary instead, in which all other words are one unknown word. A word's score given
the word before is count(pair) / count(word before) if the pair stands in the corpus more often than in the scored
document itself, and BACKOFF * count(word) / words of the corpus if not, so a text doesn't vouch for itself. A document's
score is the sum of the logarithms; its first word has no word before it and no penalty.

`backoff` has the same scores for any order as plain joins of rows, one for each n-gram of each document. Those rows take
several times the disk that this query may use (README), so here they are packed: arrays by bucket of hash, which Spark
deals out and sorts and Python workers join.

Pairs of vocabulary numbers are spread over the keys of KEY_BITS bits by a multiplication that can be undone, and a
bucket is a range of spread keys. Each task explodes its documents into pairs, sorts them, and writes for each bucket
a row of arrays: keys, and for each key the documents that hold it. The bucketed count table is the sum of these rows'
counts, one number for each key and task, so a pair that stands in every document is no heavier than another. The
exploded rows of a bucket are joined to its counts as a stream, in as many parts as their number asks for; a joined row
gives a sum for each of its documents, and these are added up by the group of documents they came from.

Pairs with a rare word (or that start a text with one) go to the bucket of that word's hash, those of two rare words to
both. All that a word's counts and those of its pairs take is then in its bucket: its own count is the number of times
that it comes second or first in a text. The bucket of a pair's first word adds the scores of pairs seen elsewhere, that
of the second the others. A rare word stands less often than any numbered word, so no bucket gets a heavy one.

Defined cases: a null or empty text has no words, log_score 0 and a null mean_log. Repeated rows are scored each. An
empty table gives no rows. Words are split at ASCII white space, and ASCII letters made small. A very long text takes
time and memory in proportion to its words in one task. Words of equal counts are all numbered or all rare, so ties
change no score. Equal hashes of different rare words would share their counts. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, groups, tidy, written

BACKOFF = 0.4
#: Most words that are numbered and broadcast (16 bytes each); rare words are joined.
WORD_BITS = 18
VOCABULARY = (1 << WORD_BITS) - 1
KEY_BITS = 2 * WORD_BITS
#: Words of the corpus for each bucket; words and documents that a task explodes at a time.
BUCKET_WORDS = 2_000_000
CHUNK_WORDS = 4_000_000
CHUNK_DOCS = 1 << 16
#: Pairs of documents' rows in one Arrow batch that a task writes.
OUT_PAIRS = 200_000
#: A bucket's rows get a copy of its counts for each JOIN_ROWS of them, but none before JOIN_ENTRIES (pair, document)
#: entries: rows get smaller and more with the corpus, entries of a bucket don't.
JOIN_ROWS = 64
JOIN_ENTRIES = 4_000_000
#: Row groups of rows of arrays: a reader and a writer hold one in memory, whatever the file's size.
ARRAYS = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "8", "parquet.page.size.row.check.max": "64"}
#: Hashes of words have this bit, numbers of words don't.
RARE = 1 << 62
#: Buckets of what is known of documents, and the first (they go down) of pairs with a rare word; pairs of such a bucket.
ABOUT, ODD = -1, -2
ODD_PAIRS = 1_000_000
_SPREAD = 0x9E3779B97F4A7C15 % (1 << KEY_BITS) | 1
_BACK = pow(_SPREAD, -1, 1 << KEY_BITS)
_MASK = np.uint64((1 << KEY_BITS) - 1)


def spread(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(_SPREAD) & _MASK


def unspread(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(_BACK) & _MASK


def planes(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which the compression of shuffles and tables packs well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def rising(values: np.ndarray) -> bytes:
    """Rising numbers as differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def unrising(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, "<u8"), dtype=np.uint64)


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & (RARE - 1) | RARE


class Hashes(dict):
    """Hashes of words; emptied when it grows beyond a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = word_hash(word)
        return h


class Numbers(Hashes):
    """Vocabulary numbers of words; others have their hash, or 0 in a closed vocabulary."""

    def __init__(self, hashes: np.ndarray, closed: bool) -> None:
        self.hashes, self.closed = hashes, closed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = word_hash(word)
        at = int(np.searchsorted(self.hashes, h))
        n = self[word] = at + 1 if at < len(self.hashes) and self.hashes[at] == h else 0 if self.closed else h
        return n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, count) of the task's texts, summed up for each CHUNK_WORDS words."""
    hashes = Hashes()
    held: list[np.ndarray] = []
    n = 0

    def summed() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["word", "n"])

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            words = words_of(raw)
            held.append(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)))
            n += len(words)
            if n >= CHUNK_WORDS:
                yield summed()
                held, n = [], 0
    if n:
        yield summed()


def vocabulary(rows: DataFrame, limit: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the vocabulary, the counts of all other words together and of these, and the number of words of the corpus."""
    counts = written(rows.mapInArrow(tidy(_word_counts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # how many words have a count: few distinct counts up to 1000, then a step of a hundredth of the count
    step = F.when(F.col("n") <= 1000, F.col("n")).otherwise(F.floor(F.pow(F.lit(1.01), F.floor(F.log(1.01, F.col("n").cast("double"))))))
    steps = counts.groupBy(step.cast("long").alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    least, taken = None, 0
    for r in sorted(steps, key=lambda r: -r.step):
        if taken + r.words > limit:
            break
        taken, least = taken + r.words, r.least
    total = sum(r.n for r in steps)
    known = counts.filter(F.col("n") >= least).toArrow() if least is not None else None  # limit rows at most
    if known is None:
        return np.empty(0, np.int64), np.array([total], np.int64), total
    words, n = (known.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(words)
    return words[order], np.concatenate([[total - int(n.sum())], n[order]]), total


def _repeats(key: np.ndarray, other: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row once, in order, and its number of times."""
    order = np.lexsort((doc, other, key))
    key, other, doc = key[order], other[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key[at], other[at], doc[at], np.diff(at, append=len(key))


def _explode(shared, buckets: int, odd_buckets: int, closed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, counts, total = shared.value
        numbers, part = Numbers(hashes, closed), TaskContext.get().partitionId() << 24
        logs = np.log(np.maximum(counts, 1)) - np.log(max(1, total))
        edges = np.array([-(-(b << KEY_BITS) // buckets) for b in range(buckets + 1)], np.uint64)
        odd_edges = np.array([RARE + -(-(b * RARE) // odd_buckets) << 1 for b in range(odd_buckets)], np.uint64)
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        n = 0

        def rows() -> Iterator[pa.RecordBatch]:
            # what is done with is let go, as several workers share an executor's memory
            sizes = np.array([len(x) for x in texts], np.int64)
            starts = np.array([i for i, x in enumerate(texts) if len(x) and x[0] >= RARE], np.uint64)
            heads = np.array([texts[int(i)][0] for i in starts], np.uint64)
            firsts = np.array([logs[x[0]] if len(x) and x[0] < RARE else 0.0 for x in texts])
            about = b"".join((np.array([d or 0 for d in ids], "<i8").tobytes(), np.array([d is None for d in ids], np.uint8).tobytes(), sizes.tobytes(), firsts.tobytes()))
            flat, own_docs = np.concatenate(texts), len(texts)
            texts.clear()
            doc = np.repeat(np.arange(own_docs, dtype=np.uint16), sizes)
            inside = doc[1:] == doc[:-1] if len(doc) else np.empty(0, bool)
            before, after, where = flat[:-1][inside], flat[1:][inside], doc[1:][inside]
            del flat, doc, inside
            odd = (before >= RARE) | (after >= RARE)
            one, two, place = np.concatenate([np.zeros(len(starts), np.uint64), before[odd]]), np.concatenate([heads, after[odd]]), np.concatenate([starts, where[odd].astype(np.uint64)])
            first, second = one >= RARE, two >= RARE
            pairs = before[~odd]
            pairs <<= np.uint64(WORD_BITS)
            pairs |= after[~odd]
            pairs = spread(pairs)
            pairs <<= np.uint64(16)
            pairs |= where[~odd]
            del before, after, where, odd
            pairs.sort()
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]]))
            times = np.diff(at, append=len(pairs)).astype("<u4")
            keys = pairs[at]
            del pairs, at
            docs = (keys & np.uint64(0xFFFF)).astype("<u2")
            keys >>= np.uint64(16)
            cuts = np.searchsorted(keys, edges)
            out: list[tuple] = [(part, ABOUT, own_docs, about, None, None, None)]

            def batch() -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "bucket", "docs", "keys", "held", "doc", "times"])
                out.clear()
                return made

            # the lowest bit of a key tells that its word is the first of the pair
            word, other, d, times_odd = _repeats(np.concatenate([two[second] << np.uint64(1), one[first] << np.uint64(1) | np.uint64(1)]), np.concatenate([one[second], two[first]]), np.concatenate([place[second], place[first]]))
            odd_cuts = [*np.searchsorted(word, odd_edges).tolist(), len(word)]
            for b, (lo, hi) in enumerate(zip(odd_cuts, odd_cuts[1:], strict=False)):
                if lo < hi:
                    out.append((part, ODD - b, own_docs, rising(word[lo:hi]), planes(other[lo:hi]), planes(d[lo:hi].astype("<u2")), planes(times_odd[lo:hi].astype("<u4"))))
            del word, other, d, times_odd, one, two, place, first, second
            held_back = 0
            for b in range(buckets):
                lo, hi = int(cuts[b]), int(cuts[b + 1])
                if lo < hi:
                    own, held = np.unique(keys[lo:hi], return_counts=True)
                    out.append((part, b, own_docs, rising(own), planes(held.astype("<u4")), planes(docs[lo:hi]), planes(times[lo:hi])))
                    held_back += hi - lo
                    if held_back >= OUT_PAIRS:
                        yield batch()
                        held_back = 0
            if out:
                yield batch()

        for batch in batches:
            for d, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(raw)
                ids.append(d)
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words)))
                n += len(words)
                if n >= CHUNK_WORDS or len(ids) >= CHUNK_DOCS:
                    yield from rows()
                    ids.clear()
                    texts.clear()
                    part, n = part + 1, 0
        if ids:
            yield from rows()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count table of each bucket from its rows of keys and numbers of each."""
    for rows in groups(batches, ["bucket"]):
        # all rows together hold at most as many keys as the bucket has words, so they are sorted once
        keys = np.concatenate([unrising(raw.as_py()) for raw in rows.column("keys")])
        counts = np.concatenate([unplanes(n.as_py(), "<u4") for n in rows.column("n")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[at], np.add.reduceat(counts, at)
        yield pa.RecordBatch.from_arrays([pa.array([rows.column("bucket")[0].as_py()], pa.int32()), pa.array([rising(keys)], pa.binary()), pa.array([planes(counts)], pa.binary())], ["bucket", "keys", "counts"])


def _summed_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for held, times in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            held, times = unplanes(held, "<u4"), unplanes(times, "<u4")
            n.append(planes(np.add.reduceat(times, np.cumsum(held, dtype=np.int64) - held.astype(np.int64)).astype("<u4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.binary())], ["bucket", "keys", "n"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, counts, total = shared.value
        logs = np.log(np.maximum(counts, 1))
        base = np.log(max(1, total))
        bucket = known = sums = None
        for batch in batches:
            for b, part, docs, keys, held, doc, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None:  # the counts come first
                    bucket, known, sums = b, unrising(keys), np.log(unplanes(held, "<i8"))
                    continue
                assert b == bucket
                keys, held, doc, times = unrising(keys), unplanes(held, "<u4"), unplanes(doc, "<u2"), unplanes(times, "<u4")
                pair = np.repeat(sums[np.searchsorted(known, keys)], held)
                words = np.repeat(unspread(keys), held)
                seen = pair > np.log(times)
                before, word = logs[words >> np.uint64(WORD_BITS)], logs[words & np.uint64((1 << WORD_BITS) - 1)]
                score = times * np.where(seen, pair - before, np.log(BACKOFF) + word - base)
                found = np.unique(doc)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([docs], pa.int32()), pa.array([found.astype("<u2").tobytes()], pa.binary()), pa.array([np.bincount(doc, score, docs)[found].tobytes()], pa.binary())], ["part", "docs", "doc", "sums"])

    return run


def _score_odd(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, counts, total = shared.value
        logs = np.log(np.maximum(counts, 1))
        base = np.log(max(1, total))
        for rows in groups(batches, ["bucket"]):
            parts, docs = rows.column("part").to_pylist(), rows.column("docs").to_pylist()
            keys = [unrising(x.as_py()) for x in rows.column("keys")]
            cuts = np.cumsum([0, *map(len, keys)])
            key = np.concatenate(keys)
            other = np.concatenate([unplanes(x.as_py(), "<u8") for x in rows.column("held")])
            doc = np.concatenate([unplanes(x.as_py(), "<u2") for x in rows.column("doc")])
            times = np.concatenate([unplanes(x.as_py(), "<u4") for x in rows.column("times")]).astype(np.int64)
            del keys, rows
            order = np.lexsort((other, key))
            new = np.ones(len(key), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])
            at = np.flatnonzero(new)
            pair = np.empty(len(key), np.int64)
            pair[order] = np.repeat(np.add.reduceat(times[order], at), np.diff(at, append=len(key)))
            words, which = np.unique(key >> np.uint64(1), return_inverse=True)
            leads = (key & np.uint64(1)).astype(bool)
            own = np.log(np.bincount(which, np.where(leads, 0, times), len(words)))[which]
            rare, seen = other >= RARE, pair > times
            theirs = logs[np.where(rare, 0, other).astype(np.int64)]
            unseen = np.log(BACKOFF) - base
            as_first = np.where(seen, np.log(pair) - own, np.where(rare, 0, unseen + theirs))
            as_second = np.where(seen, np.where(rare, 0, np.log(pair) - theirs), unseen + own)
            score = times * np.where(leads, as_first, np.where(other == 0, own - base, as_second))
            for part, n, lo, hi in zip(parts, docs, cuts, cuts[1:], strict=False):
                found = np.unique(doc[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int32()), pa.array([found.astype("<u2").tobytes()], pa.binary()), pa.array([np.bincount(doc[lo:hi], score[lo:hi], n)[found].tobytes()], pa.binary())], ["part", "docs", "doc", "sums"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = about = sums = None

    def result() -> pa.RecordBatch:
        n = len(sums)
        ids, nulls = np.frombuffer(about, "<i8", n), np.frombuffer(about, np.uint8, n, 8 * n).astype(bool)
        sizes, firsts = np.frombuffer(about, "<i8", n, 9 * n), np.frombuffer(about, "<f8", n, 17 * n)
        whole = sums + firsts
        mean = np.divide(whole, sizes, out=np.zeros(n), where=sizes > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(sizes), pa.array(whole), pa.array(mean, mask=sizes == 0)], ["key", "n_words", "log_score", "mean_log"])

    for batch in batches:
        for p, docs, doc, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if doc is None:  # what is known of the documents comes first
                if part is not None:
                    yield result()
                part, about, sums = p, more, np.zeros(docs)
            else:
                assert p == part
                sums[np.frombuffer(doc, "<u2")] += np.frombuffer(more, "<f8")
    if part is not None:
        yield result()


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """(key, n_words, log_score, mean_log) for each row of docs; a limit closes the vocabulary."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    closed = limit is not None
    hashes, counts, total = vocabulary(rows.select("text"), limit if closed else VOCABULARY)
    shared = spark.sparkContext.broadcast((hashes, counts, total))
    buckets = max(1, -(-total // BUCKET_WORDS))
    odd_buckets = max(1, -(-2 * int(counts[0]) // ODD_PAIRS))
    schema = "part long, bucket int, docs int, keys binary, held binary, doc binary, times binary"
    exploded = written(rows.mapInArrow(tidy(_explode(shared, buckets, odd_buckets, closed)), schema), "pairs", **ARRAYS)
    pairs = exploded.filter("bucket >= 0")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    numbers = pairs.select("bucket", "keys", "held", "times").mapInArrow(_summed_times, "bucket int, keys binary, n binary")
    table = written(numbers.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_count), "bucket int, keys binary, counts binary"), "counts", **ARRAYS)

    salts = pairs.groupBy("bucket").agg(F.least(F.ceil(F.count("*") / JOIN_ROWS), F.ceil(F.sum(F.octet_length("doc")) / (2 * JOIN_ENTRIES))).cast("int").alias("salts"))
    copies = table.join(salts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("part"), F.lit(0).alias("docs"), "keys", F.col("counts").alias("held"), F.lit(None).cast("binary").alias("doc"), F.lit(None).cast("binary").alias("times"))
    dealt = pairs.join(F.broadcast(salts) if buckets <= 100_000 else salts, "bucket")
    dealt = dealt.select("bucket", F.pmod(F.xxhash64("part"), F.col("salts")).cast("int").alias("salt"), "part", "docs", "keys", "held", "doc", "times")
    joined = copies.union(dealt).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.asc_nulls_first("part"))
    sums = joined.drop("salt").mapInArrow(tidy(_score(shared)), "part long, docs int, doc binary, sums binary")

    if counts[0] and not closed:
        odd = exploded.filter(F.col("bucket") <= ODD).repartition(max(parts, odd_buckets), "bucket").sortWithinPartitions("bucket")
        sums = sums.union(odd.mapInArrow(tidy(_score_odd(shared)), "part long, docs int, doc binary, sums binary"))
    about = exploded.filter(F.col("bucket") == ABOUT).select("part", "docs", F.lit(None).cast("binary").alias("doc"), F.col("keys").alias("sums"))
    added = about.union(sums).repartition(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc"))
    return added.mapInArrow(_total, "key long, n_words long, log_score double, mean_log double").withColumnRenamed("key", key)
