"""Compression of binary columns: DEFLATE in its three wrappings, and run-length codes of pictures, disks and snapshots.

Every decoder is total: a faulty input gives a null value and a fault, and output never grows beyond a bound that the
caller states. The work is a column function in Arrow batches; rows are independent, so Spark spreads it."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.plans.staging import bounded_batches, trimmed

MOST = 16 << 20
WRAPPINGS = {"raw": -15, "zlib": 15, "gzip": 31}
RESULT = T.StructType([T.StructField("value", T.BinaryType()), T.StructField("fault", T.StringType())])


class Fault(Exception):
    """What is wrong with an input."""


def deflated(raw: bytes, wrapping: str = "zlib", level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, WRAPPINGS[wrapping])
    return c.compress(raw) + c.flush()


def inflated(raw: bytes, wrapping: str = "zlib", most: int = MOST) -> bytes:
    """All members of a gzip file are joined; zeros may follow the last one, other bytes may not."""
    out, size, rest = [], 0, raw
    while True:
        d = zlib.decompressobj(WRAPPINGS[wrapping])
        try:
            part = d.decompress(rest, most - size + 1)
        except zlib.error as e:
            raise Fault(f"bad data: {str(e)[:60]}") from None
        size += len(part)
        if size > most:
            raise Fault("too long")
        if not d.eof:
            raise Fault("cut off")
        out.append(part)
        rest = d.unused_data
        if wrapping != "gzip" or not rest.strip(b"\0"):
            if rest and wrapping != "gzip":
                raise Fault("trailing bytes")
            return b"".join(out)
        if not rest.startswith(b"\x1f\x8b"):
            raise Fault("trailing bytes")


def packed_bits(raw: bytes) -> bytes:
    """Picture rows: a count byte below 128 before literals, above 128 before a repeated byte; runs of three or more repeat."""
    out, at = bytearray(), 0

    def literals(end: int) -> None:
        for i in range(at, end, 128):
            part = raw[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in re.finditer(rb"(.)\1{2,}", raw, re.DOTALL):
        literals(m.start())
        at, end = m.start(), m.end()
        while end - at > 2:
            k = min(end - at, 128)
            out += bytes([257 - k, raw[at]])
            at += k
    literals(len(raw))
    return bytes(out)


def unpacked_bits(raw: bytes, most: int = MOST) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            if at + n + 2 > len(raw):
                raise Fault("cut off")
            out += raw[at + 1 : at + n + 2]
            at += n + 2
        elif n > 128:
            if at + 2 > len(raw):
                raise Fault("cut off")
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
        if len(out) > most:
            raise Fault("too long")
    return bytes(out)


def _counted(most: int, mark: Callable[[int, int], bytes]) -> Callable[[re.Match], bytes]:
    """A run as marks that count up to most bytes each."""

    def replaced(m: re.Match) -> bytes:
        byte, whole, rest = m[0][0], *divmod(len(m[0]), most)
        if whole and rest == 1:  # a mark byte left alone could join what follows
            return mark(byte, most) * (whole - 1) + mark(byte, most - 4) + mark(byte, 5)
        return mark(byte, most) * whole + (mark(byte, rest) if rest else b"")

    return replaced


def _track(byte: int, n: int) -> bytes:
    return bytes([0xE5, byte]) + n.to_bytes(2, "big") if n >= 4 or byte == 0xE5 else bytes([byte]) * n


def marked_track(raw: bytes) -> bytes:
    """Disk tracks: the mark E5, a byte and a big-endian count for runs of four or more, and for every mark byte."""
    return re.sub(rb"\xe5+|(.)\1{3,}", _counted(0xFFFF, _track), raw, flags=re.DOTALL)


def _unmarked(raw: bytes, mark: bytes, count: Callable[[bytes], bytes], most: int) -> bytes:
    """Bytes as they stand but for the four that start with a mark."""
    out, size, at = [], 0, 0
    while at < len(raw):
        next_mark = raw.find(mark, at)
        end = len(raw) if next_mark < 0 else next_mark
        out.append(raw[at:end])
        at = end
        if next_mark >= 0:
            if at + 4 > len(raw):
                raise Fault("cut off")
            out.append(count(raw[at : at + 4]))
            at += 4
            size += len(out[-1])
        size += len(out[-2] if next_mark >= 0 else out[-1])
        if size > most:
            raise Fault("too long")
    return b"".join(out)


def unmarked_track(raw: bytes, most: int = MOST) -> bytes:
    return _unmarked(raw, b"\xe5", lambda m: m[1:2] * int.from_bytes(m[2:], "big"), most)


def _memory(byte: int, n: int) -> bytes:
    return bytes([0xED, 0xED, n, byte]) if n >= 5 or byte == 0xED and n >= 2 else bytes([byte]) * n


def marked_memory(raw: bytes) -> bytes:
    """Snapshots: ED ED, a count and a byte for runs of five or more, two or more of ED; no run right after a single ED."""
    # a byte after a single ED stands alone, so that three marks don't meet
    return re.sub(rb"(?<!\xed)\xed(?!\xed)[^\xed]|\xed{2,}|(.)\1{4,}", lambda m: m[0] if m[0][0] == 0xED and len(m[0]) == 2 and m[0][1] != 0xED else _counted(255, _memory)(m), raw, flags=re.DOTALL)


def unmarked_memory(raw: bytes, most: int = MOST) -> bytes:
    return _unmarked(raw, b"\xed\xed", lambda m: m[3:] * m[2], most)


ENCODERS: dict[str, Callable[..., bytes]] = {"deflate": deflated, "bits": packed_bits, "track": marked_track, "memory": marked_memory}
DECODERS: dict[str, Callable[..., bytes]] = {"deflate": inflated, "bits": unpacked_bits, "track": unmarked_track, "memory": unmarked_memory}


def gathered(values: Iterable[bytes | None]) -> pa.Array:
    """Values as an array, of which only the one at hand is held besides the array's own bytes."""
    data, ends, held = bytearray(), array("i", [0]), bytearray()
    for v in values:
        data += v or b""
        ends.append(len(data))
        held.append(v is not None)
    valid = pa.py_buffer(np.packbits(np.frombuffer(held, np.uint8), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(held), [valid, pa.py_buffer(ends), pa.py_buffer(data)])


def encoded(values: pa.Array, codec: str, **options) -> pa.Array:
    work = ENCODERS[codec]
    return gathered(None if v is None else work(v, **options) for v in (x.as_py() for x in values))


def decoded(values: pa.Array, bounds: pa.Array, codec: str, **options) -> pa.Array:
    """(value, fault) of each value; a null bound is MOST."""
    work, faults = DECODERS[codec], []

    def each() -> Iterable[bytes | None]:
        for v, bound in zip((x.as_py() for x in values), bounds.to_pylist(), strict=True):
            fault, out = None, None
            try:
                out = None if v is None else work(v, most=MOST if bound is None else bound, **options)
            except Fault as e:
                fault = str(e)
            faults.append(fault)
            yield out

    found = gathered(each())
    return pa.StructArray.from_arrays([found, pa.array(faults, pa.string())], ["value", "fault"], mask=values.is_null())


def encode(value: Column, codec: str, **options) -> Column:
    """The encoded bytes; null for null."""
    bounded_batches()

    @F.arrow_udf(T.BinaryType())
    def run(values: pa.Array) -> pa.Array:
        try:
            return encoded(values, codec, **options)
        finally:
            trimmed()

    return run(value)


def decode(value: Column, codec: str, most: Column | int = MOST, **options) -> Column:
    """(value, fault): the decoded bytes, or what is wrong; null for null. most bounds the output, for each row if it is a column."""
    bounded_batches()

    @F.arrow_udf(RESULT)
    def run(values: pa.Array, bounds: pa.Array) -> pa.Array:
        try:
            return decoded(values, bounds, codec, **options)
        finally:
            trimmed()

    return run(value, F.lit(most).cast("long") if isinstance(most, int) else most.cast("long"))
