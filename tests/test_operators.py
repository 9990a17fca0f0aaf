import zlib

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import binary as B
from tapeloom.operators import audit, chains, choices, rasters, sequences
from tapeloom.sources import streams


def test_check_values(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,)], "b binary")
    rows = df.select(F.crc32("b").alias("crc"), B.adler32(B.figures("b")).alias("adler"), B.boot_sum(B.figures("b")).alias("boot")).collect()
    assert (rows[0].crc, rows[0].adler) == (0xCBF43926, zlib.adler32(b"123456789"))
    assert (rows[1].adler, rows[1].boot) == (1, 0xFFFFFFFF)
    assert rows[2].adler is None


def test_sector_sum_never_is_255(spark):
    rows = spark.createDataFrame([(bytearray([255]),), (bytearray([254, 1]),), (bytearray([200, 100]),)], "b binary").select(B.sector_sum(B.figures("b")).alias("s")).collect()
    assert [r.s for r in rows] == [0, 0, 45]


def test_map_sum_drops_the_last_carry(spark):
    def fold(sector):
        total = 255
        for b in reversed(sector[:255]):
            total = (total & 255) + 1 if total > 255 else total
            total += b
        return total & 255

    sectors = [bytes((i * k + 7) % 256 for i in range(256)) for k in range(9)] + [b"", b"\xff" * 256]
    rows = spark.createDataFrame([(bytearray(s),) for s in sectors], "b binary").select(B.map_sum("b").alias("s")).collect()
    assert [r.s for r in rows] == [fold(s.ljust(256, b"\0")) for s in sectors]


@pytest.mark.parametrize("value", [0, 1, 258, 0xFFFFFF])
def test_numbers_as_bytes(spark, value):
    r = spark.range(1).select(B.packed(F.lit(value), 3).alias("l"), B.packed(F.lit(value), 3, "big").alias("b"))
    r = r.select("*", B.little(F.col("l"), 0, 3).alias("x"), B.big(F.col("b"), 0, 3).alias("y"), B.byte_at(F.col("b"), 2).alias("z")).first()
    assert (bytes(r.l), bytes(r.b), r.x, r.y, r.z) == (value.to_bytes(3, "little"), value.to_bytes(3, "big"), value, value, value & 255)


def test_chains_end_loop_and_dangle(spark):
    links = [("f", 1, 2), ("f", 2, 3), ("f", 3, None), ("f", 7, 8), ("f", 8, 7), ("f", 9, 7), ("f", 10, 99), ("g", 1, 1), ("h", 1, 2), ("h", 2, 3), ("h", 2, 3), ("h", 3, None)]
    found = {(r.file, r.block): (r.steps, r.loops) for r in chains.walk(spark.createDataFrame(links, "file string, block long, next long"), ["file"], "block", "next").collect()}
    assert found == {("f", 1): (2, False), ("f", 2): (1, False), ("f", 3): (0, False), ("f", 7): (None, True), ("f", 8): (None, True), ("f", 9): (None, True), ("f", 10): (0, False), ("g", 1): (None, True), ("h", 1): (2, False), ("h", 2): (1, False), ("h", 3): (0, False)}
    long = spark.range(300).select(F.lit("f").alias("file"), F.col("id").alias("block"), F.when(F.col("id") < 299, F.col("id") + 1).alias("next"))
    assert {r.block: r.steps for r in chains.walk(long, ["file"], "block", "next").collect()} == {i: 299 - i for i in range(300)}
    assert chains.walk(long.limit(0), ["file"], "block", "next").count() == 0


@pytest.mark.parametrize("name", sorted(streams.LAYOUTS))
def test_streams_round_trip(spark, name):
    layout = streams.LAYOUTS[name]
    chunks = [("a", 2, 5, b""), ("a", 1, 7, b"\x00\xffxyz"), ("a", 3, 1, bytes(300)), ("b", 1, 9, b"q")]
    df = spark.createDataFrame([(f, o, k, bytearray(p)) for f, o, k, p in chunks], "file string, o int, kind int, payload binary")
    files = streams.assemble(df, ["file"], "o", "kind", "payload", layout)
    got = sorted((r.file, r.ordinal, r.kind, bytes(r.payload), r.fault) for r in streams.split(files, ["file"], "content", layout).collect())
    want = sorted((f, o - 1, k if layout.kind else None, p, None) for f, o, k, p in chunks)
    assert got == want


def test_streams_report_faults(spark):
    files = spark.createDataFrame([("t", bytearray(b"\x01\x00\x05\x00\x00\x00abc")), ("e", bytearray()), ("n", None)], "file string, content binary")
    rows = streams.split(files, ["file"], "content", streams.TAGGED).collect()
    assert [(r.file, r.fault) for r in rows] == [("t", "truncated")]
    headed = streams.Layout(kind=1, length=1, header=b"HEAD")
    assert [r.fault for r in streams.split(files.limit(1), ["file"], "content", headed).collect()] == ["no header"]


def test_sequences(spark):
    df = spark.createDataFrame([("f", 1, None), ("f", 2, 5), ("f", 3, None), ("f", 4, 6)], "f string, o int, v int")
    assert [r.x for r in sequences.repeat_last(df, ["f"], ["o"], "v", "x").orderBy("o").collect()] == [None, 5, 5, 6]
    runs = sequences.runs(df, ["f"], ["o"], "v")
    assert sorted((r.run, r.v, r.length) for r in runs.collect()) == [(0, None, 1), (1, 5, 1), (2, None, 1), (3, 6, 1)]
    assert [r.v for r in sequences.unrolled(runs, ["f"], "v").orderBy("place").collect()] == [None, 5, None, 6]


def test_pointer_tables_and_sizes(spark):
    blocks = spark.createDataFrame([("a", 1, 1, 10), ("a", 2, 2, 11), ("b", 1, 2, 10), ("b", 2, 1, 12)], "f string, p int, c int, block int")
    assert [(r.f, r.n_blocks, r.first_wrong) for r in audit.out_of_order(blocks, "f", "p", "c", "block").collect()] == [("b", 2, 0)]
    files = spark.createDataFrame([("a", 2), ("b", 3), ("c", 0), ("d", -1)], "f string, size int")
    one = blocks.withColumn("one", F.lit(1))
    assert {r.f: r.fault for r in audit.size_faults(files, one, "f", "size", "one").collect()} == {"a": "none", "b": "short", "c": "none", "d": "long"}


def test_geometry_prefers_the_standard_disk(spark):
    images = spark.createDataFrame([(737280,), (737281,), (819200,), (368640,), (1,)], "size long")
    found = {r.size: r.geometry and tuple(r.geometry) for r in choices.fit_geometry(images, "size").collect()}
    assert found == {737280: (80, 2, 9), 737281: (80, 2, 9), 819200: (80, 2, 10), 368640: (80, 1, 9), 1: None}


def test_screens_turn_back(spark):
    raw = bytes((i * 31 + i // 256) % 256 for i in range(rasters.SCREEN))
    df = spark.createDataFrame([(bytearray(raw),)], "s binary").withColumn("rows", rasters.linear(F.col("s")))
    r = df.select("*", rasters.stored(F.col("rows")).alias("back")).first()
    assert bytes(r.back) == raw
    assert bytes.fromhex(r.rows)[32:64] == raw[256:288]


def test_layouts(spark):
    from tapeloom.operators import layouts
    from tapeloom.sources.disks import SECTORS

    pattern = bytearray(1024)
    pattern[16:20] = bytes([0x11, 0xAC, 0x2F, 0x40])  # row 1, channel 0: sample 0x12, period 0x1AC, effect F, parameter 0x40
    rows = layouts.notes(spark.createDataFrame([(1, pattern)], "k int, p binary"), ["k"], "p")
    assert rows.count() == 256
    hit = rows.filter("period > 0").collect()
    assert [(r["row"], r.channel, r["sample"], r.period, r.effect, r.parameter) for r in hit] == [(1, 0, 0x12, 0x1AC, 15, 0x40)]
    at = spark.createDataFrame([(0,), (20,), (21,), (357,), (682,), (683,), (-1,)], "b long").select(layouts.address(F.col("b"), SECTORS).alias("a")).collect()
    assert [r.a and tuple(r.a) for r in at] == [(1, 0), (1, 20), (2, 0), (18, 0), (35, 16), None, None]
    files = spark.createDataFrame([("a", "p"), ("a", "c"), ("a", "c"), ("b", "p")], "s string, role string")
    found = {r.s: (r.files, r.missing, r.repeated) for r in layouts.sets(files, ["s"], "role", ["p", "c", "v"]).collect()}
    assert found == {"a": (3, "v", "c"), "b": (1, "c,v", "")}


def test_look_up_gives_whole_entries(spark):
    entries = spark.createDataFrame([("d", "A", 1, 9), ("d", "a", 2, 5), ("e", "B", None, 7)], "dir string, name string, block int, size int")
    asked = spark.createDataFrame([(1, "d", "a"), (2, "e", "b"), (3, "e", "A")], "q int, dir string, name string")
    found = {r.q: (r.block, r["size"]) for r in audit.look_up(asked, entries, "dir", "name").collect()}
    assert found == {1: (1, 9), 2: (None, 7), 3: (None, None)}


def test_boundaries_of_a_long_file(spark):
    n = 120_000
    df = spark.range(n).select(F.lit("f").alias("f"), (F.col("id") / 2).cast("long").alias("at"))
    out = sequences.next_boundary(df, ["f"], "at", F.lit(-1), "stop")
    assert out.filter("stop = at + 1").count() == n - 2 and out.filter("stop = -1").count() == 2


def test_chains_unroll(spark):
    links = [("f", 1, 2), ("f", 2, 3), ("f", 3, None), ("f", 7, 8), ("f", 8, 7), ("f", 10, 99), ("g", 1, None)]
    starts = [("f", "a", 1), ("f", "b", 2), ("f", "c", 7), ("f", "d", 10), ("f", "e", 55), ("g", "a", 1)]
    rows = chains.unroll(spark.createDataFrame(links, "k string, block long, next long"), spark.createDataFrame(starts, "k string, e string, block long"), ["k"], "block", "next", "step", 5, ["e"]).collect()
    found = {}
    for r in sorted(rows):
        found.setdefault((r.k, r.e), []).append(r.node)
    assert found == {("f", "a"): [1, 2, 3], ("f", "b"): [2, 3], ("f", "c"): [7, 8, 7, 8, 7], ("f", "d"): [10], ("g", "a"): [1]}


def test_pixels_shuffle_one_row_for_each_group(spark):
    from tapeloom.operators import rasters

    rows = [(1, 0, 0b10100000), (1, 1, 0b11000000), (1, 1, 1), (2, 3, None), (2, 2, 255), (None, 0, 1), (3, 0, None)]
    out = rasters.pixels(spark.createDataFrame(rows, "k long, p int, b int"), ["k"], "p", "b")
    want = {1: [3, 2, 1, 0, 0, 0, 0, 2], 2: [4] * 8, None: [0] * 7 + [1], 3: [None] * 8}
    assert {(r.k, r.x): r.color for r in out.collect()} == {(k, x): v for k, each in want.items() for x, v in enumerate(each)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_walk_writes_its_blocks_before_joining_them(spark, monkeypatch):
    """A task that holds aggregates of both sides of the join took several times the memory."""
    from tapeloom.operators import chains

    plans, real = [], chains.staged

    def noted(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(chains, "staged", noted)
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, None), (1, 4, 9), (2, 1, 2), (2, 2, 1), (2, 2, 1)], "k int, n long, f long")
    out = {(r.k, r.n): (r.steps, r.loops) for r in chains.walk(links, ["k"], "n", "f").collect()}
    assert out == {(1, 1): (2, False), (1, 2): (1, False), (1, 3): (0, False), (1, 4): (0, False), (2, 1): (None, True), (2, 2): (None, True)}
    assert not any("Join" in p and "Aggregate" in p for p in plans)
