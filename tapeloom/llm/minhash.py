"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification, connected components.

A text's set holds the fingerprints of its distinct runs of SHINGLE words (ASCII letters lower-cased; a shorter text
is one shingle). Two permutations give all signature coordinates: the first shuffles the shingles' universe, the
second is shifted by k places for coordinate k, so that a shingle's values in all coordinates are one contiguous slice
of a table. Bands of coordinates bring candidates together; every link is confirmed on the full sets.

Texts with equal sets form a class, of which only the smallest id is compared further, so a large group of exact copies
costs as much as one text. Classes that share a band are verified inside that band's group, and only confirmed links are
connected, so a chance collision costs one comparison and never brings its neighbours together:

1. Each class is compared with the first member of each of its bands' groups. A first with many members is copied to as
   many tasks as they need. The confirmed links are connected.
2. Where a group's members still stand in several components, those outside its largest component are compared with all
   its members, in blocks of at most BLOCK classes, in which all intersections come from one matrix product. Groups with
   the same members are compared once. A pair of blocks returns at most one edge for each class.

So a group of near copies, whose links to the first join nearly all of them, costs a comparison each. Only a group of
texts that share a band without being linked costs products of its blocks, which the method asks for.

Defined cases: a null text, or one without words, has an empty set and links with nothing. A null id gives a row with
a null component that is kept. Repeated rows of an id are one document, be their texts equal or not: they share its
component and are all kept if it is the smallest. Of equal sets the smallest id stands for the others; a group's first is
its smallest id. A very long text costs time and memory in proportion to its words in one row. Other columns aren't
read, so their names may be any. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected, groups, tidy, written

#: Coordinates: bands times rows. At a similarity of 0.85 a pair shares no band with probability 2e-8, at 0.8 with 7e-6.
BANDS, ROWS = 30, 5
UNIVERSE = 1 << 21
SEED = 20240229
BLOCK = 384
#: Members of a group that one copy of its first is compared with in a task.
STAR = 128
#: Cells of the matrices in a comparison of two blocks.
CELLS = 4_000_000
#: Up to so many deals of classes to groups are broadcast (about 30 bytes each); beyond it the texts of their classes are
#: shuffled. As many ids that a later stage removes are broadcast, too.
BROADCAST_IDS = 500_000


class WordHashes(dict):
    """64-bit hashes of words; emptied when it grows beyond a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted fingerprints of the distinct runs of width words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        width = len(words)
    out = h[: len(h) - width + 1]
    for i in range(1, width):
        out = _mix(out) + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(out + np.uint64(width)))


@cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation of the universe, and the second as a window for each place: its values at the K places before."""
    rng = np.random.default_rng(SEED)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    k = BANDS * ROWS
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second[-k + 1 :], second]), k)


def signature(marks: np.ndarray) -> np.ndarray:
    """The circulant signature of a set of fingerprints: BANDS * ROWS coordinates."""
    first, second = permutations()
    at = first[(marks >> np.uint64(43)).astype(np.int64)]
    out = second[at[:2048]].min(0)
    for i in range(2048, len(at), 2048):
        out = np.minimum(out, second[at[i : i + 2048]].min(0))
    return out[::-1]  # coordinate k is the window's place before the last by k


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        out = _mix(out + rows[:, i] + np.uint64(1))
    return out.view(np.int64)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digests, keys = [], [], []
            for raw in batch.column(1).to_pylist():
                marks = shingles(raw, width, hashes)
                n.append(len(marks))
                digests.append(xxhash.xxh3_128_digest(marks.tobytes()) if len(marks) else None)
                keys.append(band_keys(signature(marks)) if len(marks) else None)
            flat = np.concatenate([k for k in keys if k is not None] or [np.empty(0, np.int64)])
            offsets = np.cumsum([0, *(BANDS if k is not None else 0 for k in keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "n_shingles", "digest", "bands"])

    return run


def _sets(width: int, columns: list[str]):
    """The rows with the fingerprints of their text in place of it; text is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(raw, width, hashes).tobytes() for raw in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sets, pa.binary())], [*columns, "marks"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _with_first(percent: int):
    """Edges between each group's first, whose rows come before the others', and the members linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, firsts = None, []
        for batch in batches:
            found = []
            for first, salt, member, i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (first, salt) != group:
                    group, firsts = (first, salt), []
                marks = np.frombuffer(raw, np.uint64)
                if not member:
                    firsts.append(marks)
                elif any(linked(f, marks, percent) for f in firsts):
                    found.append((i, first))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges (i, root of i) that join what is linked of the rows of left with those of right."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # what one set holds alone can't be in an intersection
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    rows, columns = owner[use], column[inverse[use]]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    step = max(64, CELLS // n)
    for start in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(columns, (start, start + step))
        m = np.zeros((n, min(step, int(shared.sum()) - start)), np.float32)
        m[rows[a:b], columns[a:b] - start] = 1
        common += m[left] @ m[right].T
    common = np.rint(common).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None] - common
    i, j = np.nonzero(100 * common >= percent * union)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
        if (rx := root(x)) != (ry := root(y)):
            parent[max(rx, ry)] = min(rx, ry)
    return [(x, r) for x in range(n) if (r := root(x)) != x]


#: A row's part in a comparison: on the left, on the right, or on both sides.
LEFT, RIGHT, BOTH = 0, 1, 2


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["band", "i", "j"]):
            side = np.array(rows.column("side").to_pylist())
            ids = np.array(rows.column("id").to_pylist(), np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("marks").to_pylist()]
            edges = block_links(sets, np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT), percent)
            yield pa.RecordBatch.from_arrays([pa.array(ids[[e[k] for e in edges]] if edges else [], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _with_marks(rows: DataFrame, deals: DataFrame, width: int) -> DataFrame:
    """deals (id, deals) of classes joined to the texts of their ids, as sets: (id, deal's fields, marks)."""
    few = (deals.agg(F.sum(F.size("deals"))).first()[0] or 0) <= BROADCAST_IDS
    texts = rows.join(F.broadcast(deals) if few else deals, "id").select("id", "deals", "text")
    kind = deals.schema["deals"].dataType.simpleString()
    sets = texts.mapInArrow(tidy(_sets(width, ["id", "deals"])), f"id long, deals {kind}, marks binary")
    return sets.select("id", F.explode("deals").alias("deal"), "marks").select("id", "deal.*", "marks")


def _star_links(rows: DataFrame, stars: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Confirmed links (a, b) of classes with the first members of their groups; stars holds pairs (id, first)."""
    salts = stars.groupBy("first").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    member = stars.join(salts, "first").select("id", F.struct("first", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member")).alias("deal"))
    own = salts.select(F.col("first").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("id", F.struct(F.col("id").alias("first"), "salt", F.lit(False).alias("member")).alias("deal"))
    deals = written(member.union(own).groupBy("id").agg(F.collect_list("deal").alias("deals")), "stars")  # BANDS for each class, and a copy for STAR members
    dealt = _with_marks(rows, deals, width).select("first", "salt", "member", "id", "marks")
    dealt = dealt.repartition(parts, "first", "salt").sortWithinPartitions("first", "salt", "member")
    return dealt.mapInArrow(tidy(_with_first(percent)), "a long, b long")


def _group_links(rows: DataFrame, members: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Confirmed links (a, b) inside groups (band, id, component) whose members stand in several components."""
    per = members.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"))
    split = per.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component"))["component"].alias("main"), F.max("n").alias("most"), F.count("*").alias("parts"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))
    # groups of the same members are compared once
    split = split.filter("parts > 1").groupBy("n", "s", "x").agg(F.min_by(F.struct("band", "main", "most"), "band").alias("g")).select("g.*", "n")
    split = written(split.select("band", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rights")), "split")
    odd = F.col("component") != F.col("main")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    deal = lambda i, j, side: F.struct("band", i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    one = F.array(F.when(odd, deal(F.lit(0), F.lit(0), BOTH)).otherwise(deal(F.lit(0), F.lit(0), RIGHT)))
    left = F.when(odd, F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda o: deal(block("lefts"), o, LEFT))).otherwise(F.array().cast("array<struct<band:bigint,i:int,j:int,side:int>>"))
    right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda o: deal(o, block("rights"), RIGHT))
    dealt = members.join(split, "band").withColumn("deals", F.when((F.col("lefts") == 1) & (F.col("rights") == 1), one).otherwise(F.concat(left, right)))
    deals = written(dealt.groupBy("id").agg(F.flatten(F.collect_list("deals")).alias("deals")), "deals")  # BANDS groups for each class
    rows = _with_marks(rows, deals, width).select("band", "i", "j", "side", "id", "marks")
    rows = rows.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    return rows.mapInArrow(tidy(_compare(percent)), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs.

    Links: 100 * intersection >= percent * union of the sets of runs of width words. component_id is the smallest id
    reached over links; kept marks that id's rows. key must hold integers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    sketches = written(rows.mapInArrow(tidy(_sketches(width)), "id long, n_shingles long, digest binary, bands array<long>"), "sketches")
    known = sketches.filter("id is not null and digest is not null")
    # n copies leave each task as one row; the bands of one member stand for all, as equal sets have equal signatures
    classes = written(known.groupBy("digest").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands"), F.first("n_shingles").alias("n_shingles")), "classes")
    bands = classes.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    first = bands.groupBy("band").agg(F.min(F.struct("id", "size")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    placed = written(bands.join(first, "band").select("band", "id", "size", "n", F.col("f.id").alias("first"), F.col("f.size").alias("first_size")), "bands")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() // 100_000)
    near = placed.filter(f"id != first and 100 * least(size, first_size) >= {percent} * greatest(size, first_size)")
    stars = _star_links(rows, near.select("id", "first").distinct(), width, percent, parts)
    # ids with several texts are one document: their classes are linked
    several = known.groupBy("id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).filter("d != e").select("id")
    same = known.join(several, "id").select("id", "digest").distinct().join(classes.select("digest", F.col("id").alias("lead")), "digest").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    edges = written(stars.union(same), "links")
    joined = connected(edges)
    # a group of two is done: its one pair was compared
    members = placed.filter("n > 2").join(joined, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    more = _group_links(rows, members, width, percent, parts)
    links = connected(edges.union(more))

    reached = classes.select("digest", "id").join(links, "id", "left").select("digest", F.coalesce("component", "id").alias("class_component"))
    named = sketches.select("id", "n_shingles", "digest").join(reached, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class_component", "id"))
    return named.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

