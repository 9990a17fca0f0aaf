"""The engine's column functions under SQL names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import basic, binary, codecs
from tapeloom.plans.staging import bounded_batches
from tapeloom.sources import headers

#: Functions made of others: (parameters, result, expression).
MADE = {
    "sum8": ("b BINARY", "BIGINT", "byte_figures(b).total % 256"),
    "sum16": ("b BINARY", "BIGINT", "byte_figures(b).total % 65536"),
    "header_sum": ("b BINARY", "BIGINT", "pmod(-(byte_figures(b).total + byte_figures(b).n), 256)"),
    "sector_sum": ("b BINARY", "BIGINT", "byte_figures(b).total % 255"),
    "longword_sum": ("b BINARY", "BIGINT", "pmod(-byte_figures(b).words, 4294967296)"),
    "boot_sum": ("b BINARY", "BIGINT", "4294967295 - if(byte_figures(b).words = 0, 0, (byte_figures(b).words - 1) % 4294967295 + 1)"),
    "adler32": ("b BINARY", "BIGINT", "(byte_figures(b).n + byte_figures(b).weighted) % 65521 * 65536 + (1 + byte_figures(b).total) % 65521"),
    "parity8": ("b BINARY", "BIGINT", "byte_figures(b).parity"),
    "byte_at": ("b BINARY, place INT", "BIGINT", "cast(conv(hex(substring(b, place + 1, 1)), 16, 10) AS BIGINT)"),
    "big_endian": ("b BINARY, place INT, size INT", "BIGINT", "cast(conv(hex(substring(b, place + 1, size)), 16, 10) AS BIGINT)"),
    "little_endian": ("b BINARY, place INT, size INT", "BIGINT", "cast(conv(array_join(reverse(regexp_extract_all(hex(substring(b, place + 1, size)), '(..)', 1)), ''), 16, 10) AS BIGINT)"),
    "name_hash": ("name STRING", "BIGINT", "cast(aggregate(transform(filter(split(upper(name), ''), c -> c <> ''), c -> ascii(c)), length(name), (h, c) -> (h * 13 + c) & 2047) % 72 AS BIGINT)"),
    "screen_row": ("y INT", "INT", "((y & 192) << 5) | ((y & 7) << 8) | ((y & 56) << 2)"),
}


def _decoder(codec: str):
    @F.arrow_udf(codecs.RESULT)
    def run(values: pa.Array) -> pa.Array:
        rows = []
        for v in values.to_pylist():
            try:
                rows.append(None if v is None else {"value": codecs.DECODERS[codec](v), "fault": None})
            except codecs.Fault as e:
                rows.append({"value": None, "fault": str(e)})
        return pa.array(rows, pa.struct([("value", pa.binary()), ("fault", pa.string())]))

    return run


def _encoder(codec: str):
    @F.arrow_udf(T.BinaryType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else codecs.ENCODERS[codec](v) for v in values.to_pylist()], pa.binary())

    return run


def register(spark: SparkSession) -> list[str]:
    """Make the functions usable in spark.sql; returns their names."""
    bounded_batches(spark)

    @F.arrow_udf(codecs.RESULT)
    def inflate(values: pa.Array, wrapping: pa.Array) -> pa.Array:
        rows = []
        for v, w in zip(values.to_pylist(), wrapping.to_pylist(), strict=True):
            try:
                rows.append(None if v is None else {"value": codecs.inflated(v, w), "fault": None})
            except codecs.Fault as e:
                rows.append({"value": None, "fault": str(e)})
        return pa.array(rows, pa.struct([("value", pa.binary()), ("fault", pa.string())]))

    @F.arrow_udf(T.BinaryType())
    def deflate(values: pa.Array, wrapping: pa.Array) -> pa.Array:
        return pa.array([None if v is None else codecs.deflated(v, w) for v, w in zip(values.to_pylist(), wrapping.to_pylist(), strict=True)], pa.binary())

    named = {"byte_figures": binary.figures, "map_sum": binary.map_sum, "interleaved": binary.interleaved, "inflate": inflate, "deflate": deflate, "basic_tokens": basic.tokens_of, "basic_listed": basic.listed_of}
    for codec in ("bits", "track", "memory"):
        named |= {f"pack_{codec}": _encoder(codec), f"unpack_{codec}": _decoder(codec)}
    for name, function in named.items():
        spark.udf.register(name, function)
    kinds = " ".join(f"WHEN substring(b, {at + 1}, {len(magic)}) = X'{magic.hex()}' THEN '{kind}'" for kind, at, magic in headers.MAGICS)
    lengths = " ".join(f"WHEN octet_length(b) = {n} THEN '{kind}'" for n, kind in headers.LENGTHS.items())
    made = MADE | {"sniffed": ("b BINARY", "STRING", f"CASE {kinds} {lengths} END")}
    for name, (parameters, result, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return sorted({*named, *made})
