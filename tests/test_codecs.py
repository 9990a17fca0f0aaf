import gzip
import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest

from tapeloom.functions import codecs


@pytest.mark.parametrize("codec", ["bits", "track", "memory", "deflate"])
def test_round_trips(codec):
    rng = random.Random(7)
    for _ in range(2000):
        raw = b"".join(bytes([rng.choice([0, 1, 0xE5, 0xED, 128])]) * rng.choice([1, 1, 2, 3, 4, 5, 130, 300]) for _ in range(rng.randrange(12)))
        assert codecs.DECODERS[codec](codecs.ENCODERS[codec](raw)) == raw
    assert codecs.DECODERS[codec](codecs.ENCODERS[codec](b"\0" * 70_000)) == b"\0" * 70_000


def test_fixed_codes():
    assert codecs.packed_bits(b"abccccc") == b"\x01ab\xfcc"
    assert codecs.marked_track(b"aaaa\xe5") == b"\xe5a\x00\x04\xe5\xe5\x00\x01"
    assert codecs.marked_memory(b"\xed" + b"a" * 6 + b"\xed\xed") == b"\xeda\xed\xed\x05a\xed\xed\x02\xed"


def test_gzip_members_padding_and_faults():
    two = gzip.compress(b"one") + gzip.compress(b"two")
    assert codecs.inflated(two + bytes(5), "gzip") == b"onetwo"
    for raw, wrapping, fault in ((two + b"x", "gzip", "trailing bytes"), (two[:-3], "gzip", "cut off"), (zlib.compress(b"a" * 99), "zlib", None), (zlib.compress(b"a") + b"x", "zlib", "trailing bytes"), (b"junk", "zlib", "bad data")):
        if fault:
            with pytest.raises(codecs.Fault, match=fault):
                codecs.inflated(raw, wrapping)
    with pytest.raises(codecs.Fault, match="too long"):
        codecs.inflated(zlib.compress(bytes(5000)), "zlib", 4999)


@pytest.mark.parametrize("codec", ["bits", "track", "memory"])
def test_any_bytes_decode_or_fault(codec):
    rng = random.Random(9)
    for _ in range(3000):
        raw = bytes(rng.choice([0xED, 0xE5, 0x81, 0x7F, 3, 255]) for _ in range(rng.randrange(20)))
        try:
            assert len(codecs.DECODERS[codec](raw, most=1000)) <= 1000
        except codecs.Fault:
            pass


def test_columns_report_faults(spark):
    df = spark.createDataFrame([(bytearray(zlib.compress(b"hi")),), (bytearray(b"no"),), (None,)], "z binary")
    rows = [r.d for r in df.select(codecs.decode(df.z, "deflate").alias("d")).collect()]
    assert bytes(rows[0].value) == b"hi" and rows[1].value is None and rows[1].fault.startswith("bad data") and rows[2] is None


def test_a_batch_holds_one_value_besides_its_result():
    rng = random.Random(2)
    values = [None, b"", *(rng.randbytes(20_000) for _ in range(200)), None]
    packed = codecs.encoded(pa.array(values, pa.binary()), "track")
    bounds = pa.array([None, *[20_000] * 201, 5], pa.int64())
    tracemalloc.start()
    found = codecs.decoded(packed, bounds, "track")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.field("value").to_pylist() == values and found.is_null().to_pylist() == [v is None for v in values]
    assert peak < 2 * 200 * 20_000  # lists of the values in and out took more than twice their bytes
    assert codecs.decoded(packed, pa.array([3] * 203, pa.int64()), "track").to_pylist()[:3] == [None, {"value": b"", "fault": None}, {"value": None, "fault": "too long"}]
    assert codecs.decoded(packed.slice(0, 0), bounds.slice(0, 0), "track").to_pylist() == [] == codecs.encoded(packed.slice(0, 0), "bits").to_pylist()
