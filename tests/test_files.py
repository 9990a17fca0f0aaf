import gzip
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.plans import sql
from tapeloom.sources import disks, headers, streams
from tapeloom.streaming import arrivals


@pytest.mark.parametrize("kind", sorted(headers.FORMATS))
def test_headers_round_trip(spark, kind):
    values = {f.name: F.lit(f.name.upper()[: f.size]) if f.kind == "s" else F.lit(7 + f.size) for f in headers.FORMATS[kind] if not (kind == "mod" and f.name == "magic")}
    raw = spark.range(1).select(headers.header(values, kind).alias("h"))
    got = raw.select(F.concat("h", F.lit(bytes(64))).alias("h")).select(headers.fields(F.col("h"), kind).alias("f"), headers.sniffed(F.col("h")).alias("kind")).first()
    for f in headers.FORMATS[kind]:
        if f.name in values:
            assert got.f[f.name] == (f.name.upper()[: f.size] if f.kind == "s" else 7 + f.size)
    if any(kind == k for k, _, _ in headers.MAGICS):
        assert got.kind == kind


def test_short_files_have_null_fields(spark):
    r = spark.createDataFrame([(bytearray(b"NES\x1a\x02"),), (bytearray(),)], "c binary").select(headers.sniffed(F.col("c")).alias("k"), headers.fields(F.col("c"), "ines").alias("f")).collect()
    assert (r[0].k, r[0].f.prg_banks, r[0].f.chr_banks) == ("ines", 2, None) and (r[1].k, r[1].f.prg_banks) == (None, None)


def test_faulty_headers_are_kept_dropped_or_fatal(spark):
    raw = {1: b"NES\x1a\x02\x01\x00\x00", 2: b"NES\x1a\x02", 3: b"SEN\x1a\x02\x01\x00\x00", 4: None, 5: b""}
    files = spark.createDataFrame([(k, v if v is None else bytearray(v)) for k, v in raw.items()], "k int, content binary")
    found = {r.k: (r.fault, r.header.prg_banks) for r in headers.read(files, "content", "ines").collect()}
    assert found == {1: (None, 2), 2: ("too short", 2), 3: ("wrong magic", 2), 4: ("no content", None), 5: ("wrong magic", None)}
    assert [r.k for r in headers.read(files, "content", "ines", "DROPMALFORMED").collect()] == [1]
    assert headers.read(files.filter("k = 1"), "content", "ines", "FAILFAST").first().fault is None
    with pytest.raises(Exception, match="not a file of format ines"):
        headers.read(files, "content", "ines", "FAILFAST").collect()
    with pytest.raises(ValueError):
        headers.read(files, "content", "ines", "LAX")


def test_files_are_read_and_stream_in(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.uef").write_bytes(b"UEF File!\0\x0a\x00")
    (tmp_path / "in" / "deep" / "b.bin").write_bytes(b"\x01\x00\x02\x00\x00\x00hi")
    files = headers.read_files(spark, str(tmp_path / "in"))
    assert sorted(r.k or "" for r in files.select(headers.sniffed(F.col("content")).alias("k")).collect()) == ["", "uef"]
    stream = arrivals.arriving(spark, str(tmp_path / "in"))
    query = arrivals.chunks(stream.filter("path like '%b.bin'"), streams.TAGGED).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.kind, bytes(r.payload)) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, b"hi")]
    query = arrivals.census(stream).writeStream.outputMode("complete").format("memory").queryName("census").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.format, r.files) for r in spark.table("census").collect()} == {("uef", 1), ("unknown", 1)}


def test_sql_names(spark):
    from tapeloom.functions import binary as B
    from tapeloom.operators import rasters

    names = sql.register(spark)
    assert len(names) == 27 and {"byte_figures", "sniffed", "unpack_track", "adler32"} <= set(names)
    r = spark.sql("select byte_figures(cast('ab' as binary)).total as t, inflate(deflate(cast('hello' as binary), 'gzip'), 'gzip').value as v, inflate(cast('junk' as binary), 'zlib').fault as f").first()
    assert (r.t, bytes(r.v)) == (195, b"hello") and r.f.startswith("bad data")
    rows = spark.createDataFrame([(bytearray(b"C64File\0" + bytes(range(40))), 200, "Readme.TXT"), (bytearray(b"\xed" * 300 + b"ab"), 77, "x"), (bytearray(), 0, "")], "b binary, y int, n string")
    f = B.figures("b")
    want = {"sum8": B.sum8(f), "sum16": B.sum16(f), "header_sum": B.header_sum(f), "sector_sum": B.sector_sum(f), "longword_sum": B.longword_sum(f), "boot_sum": B.boot_sum(f), "adler32": B.adler32(f), "parity8": f["parity"]}
    for name, column in want.items():
        assert [x[0] for x in rows.selectExpr(f"{name}(b)").collect()] == [x[0] for x in rows.select(column).collect()], name
    other = {"byte_at(b, 3)": B.byte_at(F.col("b"), 3), "big_endian(b, 1, 3)": B.big(F.col("b"), 1, 3), "little_endian(b, 1, 3)": B.little(F.col("b"), 1, 3), "name_hash(n)": B.name_hash(F.col("n")), "screen_row(y)": rasters.row_offset(F.col("y")), "sniffed(b)": headers.sniffed(F.col("b"))}
    for text, column in other.items():
        assert [x[0] for x in rows.selectExpr(text).collect()] == [x[0] for x in rows.select(column).collect()], text
    for codec in ("bits", "track", "memory"):
        assert all(x[0] for x in rows.selectExpr(f"unpack_{codec}(pack_{codec}(b)).value = b").collect())
    assert [bytes(x[0]) for x in rows.selectExpr("interleaved(cast('ac' as binary), cast('b' as binary))").limit(1).collect()] == [b"abc\0"]
    assert spark.sql("select basic_listed(basic_tokens('PRINT 1')) as t").first().t == "PRINT 1"


def mastered(spark, files):
    rows = [(1, i, n, bytearray(d)) for i, (n, d) in enumerate(files)]
    return disks.master(spark.createDataFrame(rows, "k long, o int, n string, d binary"), "k", "o", "n", "d").first()


def test_disks_hold_what_was_put_on_them(spark):
    files = [(f"F{i}", bytes((i * j) % 256 for j in range(i * 700))) for i in range(20)]
    image = bytes(mastered(spark, files).image)
    assert len(image) == disks.IMAGE and image[disks.FIRST[17] * 256] == 18
    at = lambda t, s: (disks.FIRST[t - 1] + s) * 256
    t, s, found, used = 18, 1, [], set()
    while t:
        used.add((t, s))
        block = image[at(t, s) : at(t, s) + 256]
        found += [block[i * 32 : i * 32 + 32] for i in range(8) if block[i * 32 + 2]]
        t, s = block[0], block[1]
    assert len(found) == 20
    for (name, data), entry in zip(files, found, strict=True):
        assert entry[5:21].rstrip(b"\xa0").decode() == name
        t, s, raw = entry[3], entry[4], b""
        while t:
            assert (t, s) not in used
            used.add((t, s))
            block = image[at(t, s) : at(t, s) + 256]
            t, s = block[0], block[1]
            raw += block[2:] if t else block[2 : s + 1]
        assert raw == data
    for t, n in enumerate(disks.SECTORS, 1):  # the header's bits are those of the sectors that no chain holds
        count, bits = image[at(18, 0) + 4 * t], int.from_bytes(image[at(18, 0) + 4 * t + 1 : at(18, 0) + 4 * t + 4], "little")
        free = {s for s in range(n) if (t, s) not in used | {(18, 0)}}
        assert count == len(free) and bits == sum(1 << s for s in free)
    assert mastered(spark, [("A", bytes(170_000))]).fault == "disk full"


def test_every_sector_has_its_place():
    assert sorted([*disks.ORDER, *disks.LISTED, disks.HEADER]) == list(range(683)) and len(disks.ORDER) == disks.CAPACITY == 664


def test_full_disks_are_faults_and_odd_images_end(spark):
    rows = [(1, 1, "BIG", bytearray(200_000)), (2, 1, "OK", bytearray(b"x")), (2, 2, "EMPTY", None)]
    made = disks.master(spark.createDataFrame(rows, "k long, o int, n string, d binary"), "k", "o", "n", "d")
    assert {r.k: r.fault for r in made.collect()} == {1: "disk full", 2: None}
    assert sorted((r.entry, bytes(r.data)) for r in disks.contents(made, "k", "image").collect()) == [(0, b"x"), (1, b"")]
    looped = bytearray(mastered(spark, [("A", bytes(600))]).image)
    first = disks.FIRST[16] * 256
    looped[first : first + 2] = bytes([17, 0])
    odd = spark.createDataFrame([(1, looped), (2, bytearray(10)), (3, None)], "k long, image binary")
    assert [(r.k, r.n_blocks) for r in disks.contents(odd, "k", "image").collect()] == [(1, 683)]


def test_gzip_of_two_members_in_a_column(spark):
    sql.register(spark)
    raw = gzip.compress(b"a") + gzip.compress(b"b")
    assert bytes(spark.createDataFrame([(bytearray(raw),)], "z binary").selectExpr("inflate(z, 'gzip').value as v").first().v) == b"ab"


def test_joined_chunks_are_held_once():
    rows = [[bytes([i]) * 1000, b"", bytes(19_000)] for i in range(100)]
    chunks, before = pa.array(rows, pa.list_(pa.binary())), pa.total_allocated_bytes()
    tracemalloc.start()
    found = streams._joined.func(chunks)
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert found.to_pylist() == [b"".join(r) for r in rows]
    assert peak < 1.5 * 100 * 20_000  # a list of the files and an array of them took twice their bytes


def test_images_are_held_once():
    places = [[{"place": i, "raw": b"x"}, {"place": 682, "raw": bytes([i]) * disks.SECTOR}] for i in range(disks.IMAGES)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(disks.IMAGES)), pa.array(places, pa.list_(pa.struct([("place", pa.int32()), ("raw", pa.binary())])))], ["disk", "found"])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    found = next(disks._laid(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    for i, image in enumerate(found.column(1).to_pylist()):
        assert len(image) == disks.IMAGE and image[i * disks.SECTOR] == ord("x") and image[-disks.SECTOR :] == bytes([i]) * disks.SECTOR
    assert peak < 1.5 * disks.IMAGES * disks.IMAGE  # a list of the images and an array of them took twice their bytes
