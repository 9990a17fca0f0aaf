"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source is a queue of token ids: its documents one after another. Windows of about WINDOW_SEQUENCES sequences are
filled in turn; in each every queue is served its share of tokens. A queue is served in quanta, equal blocks of at most a
1024th of a window: its credit grows with the tokens that are served in all, a block is due when the credit reaches its
middle, and what is owed below that is carried into the next window. So block b of k of a queue whose share is that of
its tokens is due at (2b + 1) / (2k) of all tokens: no queue needs to know the others, a partition can start anywhere
with the deficits of all windows before it, and any number of sources costs rows of Spark tables, nothing on the driver.

Named queues with weights of their own come first: they are served in proportion to their weights, and when one has run
dry the others share its place; all other queues follow when the named ones have run dry, in proportion to their tokens.

Inside a window the queues stand one after another, so documents are cut only at the ends of sequences and windows.
A window holds the tokens due in it, so its size differs from the set one by less than a quantum for each queue. All
sequences are full but the last.

Defined cases: a null or empty text is a document of the end id alone. A null source is a queue of its own. Two blocks
due at once stand in the order of their queues' names. Repeated rows are packed each. A very long text is cut at windows
and sequences like any other, and its ids are held in one row. Other columns aren't read, so their names may be any. An
empty table packs to no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, tidy, totals_before, written
from .tokens import encoder

LENGTH = 1024
WINDOW_SEQUENCES = 256
#: Quanta of a queue that would fill a window.
QUANTA = 1024
#: Up to so many totals of queues by partition, or by window, are broadcast (about 40 bytes each); beyond it they are
#: joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass
class Turns:
    """Which window serves which tokens of a queue. named: weight and tokens of each named queue; rest: tokens of all others."""

    named: list[tuple[int, int]]
    rest: int
    size: int
    quantum: int

    def window(self, weight: int, total: int, blocks: int, b: int) -> int:
        """The window in which block b of a queue is due; weight is 0 for a queue without a name."""
        if not weight:
            ahead = sum(n for _, n in self.named)
            return (2 * blocks * ahead + (2 * b + 1) * self.rest) // (2 * blocks * self.size)
        # at that time a queue of weight 1 would have been served middle / scale tokens
        middle, scale = (2 * b + 1) * total, 2 * blocks * weight
        return sum(min(scale * n, w * middle) for w, n in self.named) // (scale * self.size)

    def runs(self, weight: int, total: int, first: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(window, token, tokens) of the tokens first, first + 1, ... of a queue of so many."""
        blocks = -(-total // self.quantum)
        block = lambda token: ((token + 1) * blocks - 1) // total
        token, end = first, first + count
        while token < end:
            low, high = block(token), block(end - 1)
            window = self.window(weight, total, blocks, low)
            while low < high:  # the last block of the window
                middle = (low + high + 1) // 2
                if self.window(weight, total, blocks, middle) == window:
                    low = middle
                else:
                    high = middle - 1
            stop = min(end, (low + 1) * total // blocks)
            yield window, token, stop - token
            token = stop


def _runs_of(turns: Turns):
    @F.arrow_udf("array<struct<window:bigint,token:bigint,size:bigint>>")
    def run(weight: pa.Array, total: pa.Array, first: pa.Array, count: pa.Array) -> pa.Array:
        found = [[{"window": w, "token": t, "size": n} for w, t, n in turns.runs(*row)] for row in zip(*(c.to_pylist() for c in (weight, total, first, count)), strict=True)]
        return pa.array(found, pa.list_(pa.struct([("window", pa.int64()), ("token", pa.int64()), ("size", pa.int64())])))

    return run


def tokenised(docs: DataFrame, file: str, key: str, text: str, source: str, end_id: int) -> DataFrame:
    """(key, queue, part, at, n, ids): ids in chunks of a partition's rows, at counts the tokens before in the part's queue.

    part is the number of the partition, which makes up the order of a queue's documents together with at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), {}, encoder(file).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            queues, at, n = batch.column(1).to_pylist(), [], []
            ids = [raw + end for raw in encode(batch.column(2).to_pylist())]
            for q, raw in zip(queues, ids, strict=True):
                at.append(seen.get(q, 0))
                n.append(len(raw) // 4)
                seen[q] = at[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["key", "queue", "part", "at", "n", "ids"])
        encoder(file).forget()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("queue"), F.col(text).alias("text"))
    return written(rows.mapInArrow(tidy(run), "key long, queue string, part int, at long, n long, ids binary"), "tokens")


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which nulls are equal; the right side is broadcast if its rows are few enough."""
    right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right
    same = " and ".join(f"l.`{c}` <=> r.`{c}`" for c in on)
    return left.alias("l").join(right.alias("r"), F.expr(same)).select("l.*", *(F.col(f"r.`{c}`") for c in right.columns if c not in on))


def pack(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 0, length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES, weights: dict[str, int] | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue (and ids, as 32-bit integers).

    weights gives queues positive whole weights; queues without one are served when those with one have run dry."""
    bounded_batches(docs.sparkSession)
    weights = weights or {}
    tokens = tokenised(docs, file, key, text, source, end_id)
    parts = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("tokens")), "parts")
    totals = parts.groupBy("queue").agg(F.sum("tokens").alias("total"))
    named = [(weights[r.queue], r.total) for r in totals.filter(F.col("queue").isin(list(weights))).collect()]  # a row for each weight at most
    everything = totals.agg(F.sum("total")).first()[0] or 0
    size = length * window_sequences
    runs = _runs_of(Turns(named, everything - sum(n for _, n in named), size, max(1, size // QUANTA)))
    weight = F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("queue")], F.lit(0)) if weights else F.lit(0)

    # tokens of a queue in the partitions before: few rows for each queue, none of them documents
    bases = totals_before(parts, ["queue"], "part", "tokens", "base")
    bases = bases.alias("b").join(totals.alias("t"), F.expr("b.queue <=> t.queue")).select("b.*", "total")
    bases = written(bases.withColumn("weight", weight.cast("long")), "bases")

    # where the tokens of a queue in a window stand
    served = bases.select("queue", F.explode(runs("weight", "total", "base", "tokens")).alias("r")).select("queue", "r.*")
    served = written(served.groupBy("queue", "window").agg(F.sum("size").alias("size"), F.min("token").alias("first")), "served")
    windows = served.groupBy("window").agg(F.sum("size").alias("all")).withColumn("one", F.lit(0))
    starts = totals_before(windows, ["one"], "window", "all", "start").select("window", "start")
    inside = F.sum("size").over(Window.partitionBy("window").orderBy("queue")) - F.col("size")
    layout = written(served.withColumn("inside", inside).join(starts, "window").select("queue", "window", (F.col("start") + F.col("inside") - F.col("first")).alias("shift")), "layout")

    placed = _joined(tokens, bases.select("queue", "part", "base", "total", "weight"), ["queue", "part"])
    placed = placed.select("key", "queue", (F.col("base") + F.col("at")).alias("first"), "n", "ids", runs("weight", "total", F.col("base") + F.col("at"), F.col("n")).alias("runs"))
    cut = lambda ids, at, n: F.substring(ids, (4 * at + 1).cast("int"), (4 * n).cast("int"))
    at = lambda r: r["token"] - F.col("first")
    pieces = F.transform("runs", lambda r: F.struct(r["window"].alias("window"), r["token"].alias("token"), at(r).alias("at"), r["size"].alias("size"), cut(F.col("ids"), at(r), r["size"]).alias("ids")))
    pieces = placed.select("key", "queue", F.col("n").alias("doc_tokens"), F.explode(pieces).alias("r")).select("key", "queue", "doc_tokens", "r.*")
    pieces = _joined(pieces, layout, ["queue", "window"]).withColumn("place", F.col("shift") + F.col("token"))

    def split(sequence: Column) -> Column:
        low = F.greatest(F.col("place"), sequence * length)
        n = F.least(F.col("place") + F.col("size"), (sequence + 1) * length) - low
        ids = cut(F.col("ids"), low - F.col("place"), n)
        return F.struct(sequence.alias("sequence_id"), (low - sequence * length).alias("offset"), (F.col("at") + low - F.col("place")).alias("start"), n.alias("length"), F.crc32(ids).alias("ids_crc32"), *([ids.alias("ids")] if with_ids else []))

    last = F.floor((F.col("place") + F.col("size") - 1) / length)
    found = pieces.select("key", "queue", "doc_tokens", F.explode(F.transform(F.sequence(F.floor(F.col("place") / length), last), split)).alias("p")).select("key", "queue", "doc_tokens", "p.*")
    return found.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", *(["ids"] if with_ids else []))
