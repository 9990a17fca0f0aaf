"""Byte-level columns: figures of a binary value, from which the checksums of many formats follow in closed form.

Only the sums need the bytes; they come from one vectorised pass in Arrow batches. All else is arithmetic on columns
and stays in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIGURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n", "parity", "total", "weighted", "words")])
_ARROW = pa.struct([(n, pa.int64()) for n in FIGURES.names])


@F.arrow_udf(FIGURES)
def figures(values: pa.Array) -> pa.Array:
    """n bytes; their xor; their sum; their sum weighted with n, n - 1, ... 1; the sum of big-endian 32-bit words.

    Bytes that don't fill a last word are padded with zeros. A null value has null figures."""
    flat, starts = _flat(values)
    n = np.diff(starts)
    own = np.flatnonzero(n)  # empty values have no figures but zeros
    at, wide = starts[:-1][own], flat.astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(starts[:-1], n)
    found = {"n": n, **{k: np.zeros(len(n), np.int64) for k in FIGURES.names[1:]}}
    if len(own):
        found["parity"][own] = np.bitwise_xor.reduceat(flat, at)
        found["total"][own] = np.add.reduceat(wide, at)
        found["weighted"][own] = n[own] * found["total"][own] - np.add.reduceat(wide * place, at)
        found["words"][own] = np.add.reduceat(wide << (8 * (3 - place % 4)), at)
    return pa.StructArray.from_arrays([pa.array(found[k]) for k in FIGURES.names], fields=list(_ARROW), mask=values.is_null())


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow array of binary values, and where each value starts, and the end; null values are empty."""
    kept = values.cast(pa.large_binary()).fill_null(b"")
    kept = pa.concat_arrays([kept])  # one buffer from its start on
    starts = np.frombuffer(kept.buffers()[1], np.int64, len(kept) + 1, 8 * kept.offset)
    return np.frombuffer(kept.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def sum8(f: Column) -> Column:
    """Additive checksum of a tape block."""
    return f["total"] % 256


def sum16(f: Column) -> Column:
    """Additive checksum of a cartridge."""
    return f["total"] % 65536


def header_sum(f: Column) -> Column:
    """Each byte and one more taken off zero, modulo 256."""
    return F.pmod(-(f["total"] + f["n"]), F.lit(256))


def sector_sum(f: Column) -> Column:
    """Sum with end-around carry that never gives 255."""
    return f["total"] % 255


def longword_sum(f: Column) -> Column:
    """The 32-bit value that brings the sum of all words to zero."""
    return F.pmod(-f["words"], F.lit(1 << 32))


def boot_sum(f: Column) -> Column:
    """Complement of the sum of words with end-around carry."""
    carried = F.when(f["words"] == 0, F.lit(0)).otherwise((f["words"] - 1) % ((1 << 32) - 1) + 1)
    return F.lit((1 << 32) - 1) - carried


def adler32(f: Column) -> Column:
    return (f["n"] + f["weighted"]) % 65521 * 65536 + (1 + f["total"]) % 65521


def blocks(content: Column, size: int) -> Column:
    """An array of (number, bytes) of blocks of size bytes; the last may be shorter. Empty for no bytes."""
    count = F.ceil(F.octet_length(content) / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("number"), F.substring(content, i * size + 1, F.lit(size)).alias("block")))


def byte_at(content: Column, at: Column | int) -> Column:
    """The byte at a place counted from 0, as a number."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(content, at + 1, F.lit(1))), 16, 10).cast("long")


def _turned(digits: Column, size: int) -> Column:
    """Hexadecimal digits with their bytes in the other order."""
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))


def little(content: Column, at: Column | int, size: int) -> Column:
    """A little-endian whole number of up to seven bytes."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(_turned(F.hex(F.substring(content, at + 1, F.lit(size))), size), 16, 10).cast("long")


def big(content: Column, at: Column | int, size: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(content, at + 1, F.lit(size))), 16, 10).cast("long")


def packed(value: Column, size: int, order: str = "little") -> Column:
    """A whole number as size bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(_turned(digits, size) if order == "little" else digits)


@F.arrow_udf(T.BinaryType())
def interleaved(even: pa.Array, odd: pa.Array) -> pa.Array:
    """The bytes of two chips in turn, as a wide bus reads them; the shorter one counts as filled up with zeros."""
    out = []
    for a, b in zip(even.to_pylist(), odd.to_pylist(), strict=True):
        if a is None or b is None:
            out.append(None)
            continue
        grid = np.zeros((max(len(a), len(b)), 2), np.uint8)
        grid[: len(a), 0], grid[: len(b), 1] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        out.append(grid.tobytes())
    return pa.array(out, pa.binary())


def name_hash(name: Column, slots: int = 72) -> Column:
    """The slot of a file name in a directory's table: case folded, 13 times the last value plus the next character."""
    codes = F.transform(F.filter(F.split(F.upper(name), ""), lambda c: c != ""), F.ascii)
    return (F.aggregate(codes, F.length(name), lambda h, c: (h * 13 + c).bitwiseAND(2047)) % slots).cast("long")


@F.arrow_udf(T.LongType())
def map_sum(values: pa.Array) -> pa.Array:
    """Checksum of 256-byte map sectors: bytes 254 down to 0 on 255, each carry but the last added back in.

    The sectors of a batch are folded together, byte place by byte place; shorter ones are padded with zeros."""
    raw = [v.as_py() for v in values if v.is_valid]
    grid = np.frombuffer(b"".join(r[:256].ljust(256, b"\0") for r in raw), np.uint8).reshape(len(raw), 256).astype(np.int64)
    total = np.full(len(raw), 255)
    for place in range(254, -1, -1):
        total = np.where(total > 255, (total & 255) + 1, total) + grid[:, place]
    found = iter((total & 255).tolist())
    return pa.array([next(found) if v.is_valid else None for v in values], pa.int64())
