"""Chunk streams: files that are one chunk after another, each with a kind, a length and a payload.

Tapes, snapshots, recordings and pictures share this shape and differ in the widths and order of the fields. Writing
is a grouped concatenation; reading walks the lengths of each file, the one part that has to go in order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.binary import packed
from tapeloom.functions.codecs import gathered
from tapeloom.plans.staging import bounded_batches, trimmed


@dataclass(frozen=True)
class Layout:
    """Widths in bytes of kind and length, their order, and what the length counts besides the payload."""

    kind: int
    length: int
    order: str = "little"
    extra: int = 0
    pad: int = 1
    kind_first: bool = True
    header: bytes = b""


#: Fixed by the formats.
TAGGED = Layout(kind=2, length=4)
IFF = Layout(kind=4, length=4, order="big", pad=2)
SNAPSHOT = Layout(kind=4, length=4)
TAPE = Layout(kind=0, length=2)
RECORDING = Layout(kind=1, length=4, extra=5)
LAYOUTS = {"uef": TAGGED, "iff": IFF, "szx": SNAPSHOT, "tap": TAPE, "rzx": RECORDING}


@F.arrow_udf(T.BinaryType())
def _joined(chunks: pa.Array) -> pa.Array:
    try:
        return gathered(b"".join(x.as_py() for x in row.values) for row in chunks)
    finally:
        trimmed()


def assemble(chunks: DataFrame, keys: list[str], order: str, kind: str | None, payload: str, layout: Layout) -> DataFrame:
    """(keys, content): the chunks of each file in their order, as bytes. A file is one row, of at most 2 GB."""
    bounded_batches(chunks.sparkSession)
    size = F.octet_length(payload)
    fields = [packed(F.col(kind), layout.kind, layout.order)] if layout.kind and kind else []
    length = packed(size + layout.extra, layout.length, layout.order)
    fields = [*fields, length] if layout.kind_first else [length, *fields]
    padding = F.unhex(F.repeat(F.lit("00"), F.pmod(-size, F.lit(layout.pad)).cast("int")))
    chunk = F.concat(*fields, F.col(payload), padding)
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), chunk.alias("c")))), lambda x: x["c"])
    return chunks.groupBy(*keys).agg(listed.alias("_chunks")).select(*keys, _joined(F.concat(F.array(F.lit(layout.header)), "_chunks")).alias("content"))


def split(files: DataFrame, keys: list[str], content: str, layout: Layout) -> DataFrame:
    """(keys, ordinal, kind, payload, fault) for each chunk; a file that ends inside a chunk has a last row with the
    rest as payload and fault `truncated`, one without the layout's header a row with fault `no header`."""
    bounded_batches(files.sparkSession)
    width = layout.kind + layout.length

    def walk(raw: bytes | None) -> Iterator[tuple[int, int | None, bytes, str | None]]:
        raw = raw or b""
        if not raw.startswith(layout.header):
            yield 0, None, raw, "no header"
            return
        at, ordinal = len(layout.header), 0
        while at < len(raw):
            first, second = (layout.kind, layout.length) if layout.kind_first else (layout.length, layout.kind)
            a, b = raw[at : at + first], raw[at + first : at + width]
            kind, length = (a, b) if layout.kind_first else (b, a)
            size = int.from_bytes(length, layout.order) - layout.extra
            if at + width > len(raw) or size < 0 or at + width + size > len(raw):
                yield ordinal, None, raw[at:], "truncated"
                return
            yield ordinal, int.from_bytes(kind, layout.order) if layout.kind else None, raw[at + width : at + width + size], None
            at += width + size + -size % layout.pad
            ordinal += 1

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, ordinals, kinds, faults = [], [], [], []

        def payloads() -> Iterator[bytes]:
            for i, raw in enumerate(batch.column(len(keys))):
                for ordinal, kind, payload, fault in walk(raw.as_py()):
                    at.append(i)
                    ordinals.append(ordinal)
                    kinds.append(kind)
                    faults.append(fault)
                    yield payload

        held = gathered(payloads())
        own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keys)]]
        rest = [pa.array(ordinals, pa.int32()), pa.array(kinds, pa.int64()), held, pa.array(faults, pa.string())]
        return pa.RecordBatch.from_arrays([*own, *rest], [*keys, "ordinal", "kind", "payload", "fault"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield found(batch)
            trimmed()

    chosen = files.select(*keys, F.col(content).cast("binary"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.select(*keys).dtypes) + ", ordinal int, kind long, payload binary, fault string"
    return chosen.mapInArrow(run, schema)
