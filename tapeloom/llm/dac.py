"""Directly addressable codes: token ids in chunk levels with continuation bitmaps and rank directories.

A segment is a block of bytes that holds whole documents. Each id is cut into chunks from its low bits up. Level 0 has
the lowest chunk of every id; a level's bitmap marks the ids that go on, and only these have a chunk in the next level.
The rank directory counts the marks before every 512 entries, so the place of an id's next chunk is one look-up and a
count inside 512 bits: any token is read without decoding a block. The widths of the levels are those of least size
for the segment's ids.

Layout of a segment, little-endian:
- header: b"DAC1", levels u32, ids u32, documents u32
- for each document: id i64 (the smallest i64 for null), ids u32
- for each level: width u32, entries u32, chunks packed with the highest bit first, then, but for the last level, the
  bitmap in the same bit order and the directory as u32; each part is padded to whole bytes

Segments are rows of a Parquet table, which any store that Spark reaches can hold; row groups give them by number. They
are stored without further compression, so that a token costs the bytes that the codes say. `lookup` reads single tokens
by their places in the whole table, and `read` checks each document's first token by that way.

Defined cases: a null or empty text holds the end id alone. Null ids come first and read back as null. Repeated rows
are all kept; rows of one id are in the order of their texts. A very long text is a segment of its own, of at most 2 GB.
Other columns aren't read, so their names may be any. An empty table writes no segment, and a place that isn't there has
no row in `lookup`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, tidy, totals_before, written
from .tokens import encoder

MAGIC = b"DAC1"
BLOCK = 512
#: A segment is closed after the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
#: Up to so many parts' starts are broadcast (12 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
NULL_ID = -(1 << 63)
#: Most places that one row asks of a segment.
LIST = 1 << 16


def widths(ids: np.ndarray) -> list[int]:
    """Widths of the levels of least size in bits, by dynamic programming over the number of bits of the ids."""
    bits = np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(np.int64)
    most = max(1, int(bits.max(initial=1)))
    over = [len(ids), *(int((bits > i).sum()) for i in range(1, most))]  # ids with a chunk that starts at bit i
    best: list[tuple[int, list[int]]] = [(0, [])] * (most + 1)
    for start in range(most - 1, -1, -1):
        best[start] = min((over[start] * (end - start + (end < most)) + best[end][0], [end - start, *best[end][1]]) for end in range(start + 1, most + 1))
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def _unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - width :] = bits
    return np.packbits(full).view(">u4").astype(np.uint32)


def encode(documents: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A segment of (id, token ids) in their order."""
    ids = np.concatenate([x for _, x in documents] or [np.empty(0, np.uint32)]).astype(np.uint32)
    sizes = widths(ids)
    out = [MAGIC, struct.pack("<III", len(sizes), len(ids), len(documents))]
    out += [struct.pack("<qI", NULL_ID if d is None else d, len(x)) for d, x in documents]
    for level, width in enumerate(sizes):
        out += [struct.pack("<II", width, len(ids)), _pack(ids & np.uint32((1 << width) - 1), width)]
        if level + 1 < len(sizes):
            ids = ids >> np.uint32(width)
            on = ids > 0
            counts = np.add.reduceat(on, np.arange(0, len(on), BLOCK)) if len(on) else np.empty(0, np.int64)
            out += [np.packbits(on).tobytes(), (np.cumsum(counts) - counts).astype("<u4").tobytes()]
            ids = ids[on]
    return b"".join(out)


class Segment:
    """Reads a segment: its documents, all its ids, or any one of them."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a DAC1 segment")
        self.raw = memoryview(raw)
        levels, self.n, documents = struct.unpack_from("<III", raw, 4)
        table = np.frombuffer(raw, np.dtype([("id", "<i8"), ("n", "<u4")]), documents, 16)
        self.documents = [None if d == NULL_ID else d for d in table["id"].tolist()]
        self.sizes = table["n"].astype(np.int64)
        at = 16 + 12 * documents
        self.levels: list[tuple[int, int, int, int, int]] = []  # width, entries, where chunks, bitmap and directory start
        for level in range(levels):
            width, n = struct.unpack_from("<II", raw, at)
            chunks = at + 8
            bitmap = chunks + (n * width + 7) // 8
            directory = bitmap + (n + 7) // 8
            self.levels.append((width, n, chunks, bitmap, directory))
            at = bitmap if level + 1 == levels else directory + 4 * -(-n // BLOCK)

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, at, shift = np.zeros(self.n, np.uint32), np.arange(self.n), 0
        for level, (width, n, chunks, bitmap, directory) in enumerate(self.levels):
            out[at] |= _unpack(self.raw[chunks:bitmap], width, n) << np.uint32(shift)
            if level + 1 < len(self.levels):
                at = at[np.unpackbits(np.frombuffer(self.raw[bitmap:directory], np.uint8), count=n).astype(bool)]
                shift += width
        return out

    def id(self, place: int) -> int:
        """The id at a place, from its own chunks only."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = shift = 0
        for level, (width, _, chunks, bitmap, directory) in enumerate(self.levels):
            first = place * width
            word = int.from_bytes(self.raw[chunks + first // 8 : chunks + (first + width + 7) // 8], "big")
            spare = -(first + width) % 8
            value |= (word >> spare & ((1 << width) - 1)) << shift
            if level + 1 == len(self.levels) or not self.raw[bitmap + place // 8] >> (7 - place % 8) & 1:
                break
            block = place // BLOCK
            inside = int.from_bytes(self.raw[bitmap + block * BLOCK // 8 : bitmap + place // 8 + 1], "big") >> (7 - place % 8)
            place = struct.unpack_from("<I", self.raw, directory + 4 * block)[0] + inside.bit_count() - 1
            shift += width
        return value


def write(docs: DataFrame, file: str, to: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> None:
    """Write the ids of all texts, each followed by end_id, in ascending order of key, as a table of segments.

    part and number order the segments; before counts the ids of the part's earlier segments."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def segment() -> pa.RecordBatch:
            columns = [[part], [number], [before], [size], [encode(held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "number", "before", "n_ids", "segment"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for d, raw in zip(keys, encoder(file).encode(batch.column(1).to_pylist()), strict=True):
                held.append((d, np.concatenate([np.frombuffer(raw, "<u4"), end])))
                size += len(held[-1][1])
                if size >= SEGMENT_IDS:
                    yield segment()
                    number, before, held, size = number + 1, before + size, [], 0
        encoder(file).forget()
        if held:
            yield segment()

    rows.mapInArrow(tidy(run), "part int, number int, before long, n_ids long, segment binary").write.option("compression", "none").parquet(to)


def _placed(spark: SparkSession, at: str) -> DataFrame:
    """The segments of a written table with the number of ids before each."""
    segments = spark.read.parquet(at)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).withColumn("all_parts", F.lit(0))
    starts = written(totals_before(parts, ["all_parts"], "part", "n_ids", "base").select("part", "base"), "starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return segments.join(starts, "part").select("part", "number", (F.col("base") + F.col("before")).alias("first"), "n_ids", "segment")


def lookup(spark: SparkSession, at: str, places: DataFrame, place: str = "place") -> DataFrame:
    """(place, id): the ids at places of a written table, counted from 0 through all documents, each read alone.

    Segments are found by equal stretches of SEGMENT_IDS places, and each gets its places in lists of at most LIST."""
    segments = _placed(spark, at)
    stretch = lambda c: F.floor(c / SEGMENT_IDS)
    spans = segments.select("part", "number", "first", "n_ids", F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("first") + F.col("n_ids") - 1))).alias("stretch"))
    asked = places.select(F.col(place).cast("long").alias("at")).filter("at is not null").distinct().withColumn("stretch", stretch(F.col("at")))
    found = asked.join(spans, "stretch").filter("at >= first and at < first + n_ids")
    lists = found.groupBy("part", "number", F.floor(F.col("at") / LIST)).agg(F.collect_list("at").alias("places")).select("part", "number", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                segment = Segment(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([segment.id(p - first) for p in own], pa.int64())], ["place", "id"])

    joined = segments.join(lists, ["part", "number"]).select("first", "segment", "places")
    return joined.mapInArrow(run, "place long, id long").withColumnRenamed("place", place)


def read(spark: SparkSession, at: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document of a written table, and its ids where with_ids is set."""
    bounded_batches(spark)
    placed = _placed(spark, at).select("first", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(raw.as_py())
                flat, ends = segment.ids().astype("<u4"), np.cumsum(segment.sizes)
                cuts = list(zip((ends - segment.sizes).tolist(), ends.tolist(), strict=True))
                if any(segment.id(a) != flat[a] for a, b in cuts if a < b):
                    raise ValueError(f"the directory of the segment at {first} leads to other ids")
                columns = [pa.array(segment.documents, pa.int64()), pa.array(first + ends - segment.sizes, pa.int64()), pa.array(segment.sizes, pa.int64()), pa.array([zlib.crc32(flat[a:b]) for a, b in cuts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([flat[a:b].tobytes() for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return placed.mapInArrow(tidy(run), "key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("key", key)
