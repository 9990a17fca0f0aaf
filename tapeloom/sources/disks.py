"""Disk images of 35 tracks: laid out from file rows, and read as sectors, directory entries and files.

Both ways are joins and groupings of sector rows. Files get running block numbers; a block's number on its disk gives
its place through one fixed order of the sectors, so no block waits for another. Reading turns an image into rows of
sectors with their links, and follows all chains of all images at once by doubling. Only an image itself, 175 kB at
most, is ever put together in one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.binary import big, byte_at, little, packed
from tapeloom.functions.codecs import gathered
from tapeloom.operators.chains import unroll
from tapeloom.plans.staging import bounded_batches, staged, totals_before, trimmed

#: Fixed by the format.
SECTORS = [21] * 17 + [19] * 7 + [18] * 6 + [17] * 5
FIRST = [sum(SECTORS[:t]) for t in range(35)]
SECTOR, DATA, IMAGE = 256, 254, 683 * 256
DIRECTORY, INTERLEAVE, DIRECTORY_INTERLEAVE, MOST_FILES = 18, 10, 3, 144
PROGRAM = 0x82
#: Blocks for files: all but the directory's track.
CAPACITY = sum(SECTORS) - SECTORS[DIRECTORY - 1]
ENTRIES = 8
#: Images that a Python worker puts together before it hands them on.
IMAGES = 16


def spaced(k: int, n: int, step: int) -> int:
    """The k-th of n sectors when each stands step after the last; a full round goes on one further."""
    rounds = n // gcd(n, step)
    return (k * step + k // rounds) % n


#: Tracks in the order in which they fill, and all data sectors (counted through the disk) in theirs.
TRACKS = [*range(DIRECTORY - 1, 0, -1), *range(DIRECTORY + 1, 36)]
ORDER = [FIRST[t - 1] + spaced(k, SECTORS[t - 1], INTERLEAVE) for t in TRACKS for k in range(SECTORS[t - 1])]
#: The directory's sectors in their order; sector 0 of the track is the disk's header.
LISTED = [FIRST[DIRECTORY - 1] + 1 + spaced(k, SECTORS[DIRECTORY - 1] - 1, DIRECTORY_INTERLEAVE) for k in range(SECTORS[DIRECTORY - 1] - 1)]
HEADER = FIRST[DIRECTORY - 1]


def blocks_of(data: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(data) / DATA)).cast("long")


def _from(values: list[int], at: Column) -> Column:
    """The value at a place of a fixed table, which is one literal of three bytes each; null outside it."""
    return F.when(at >= 0, big(F.lit(b"".join(v.to_bytes(3, "big") for v in values)), (at * 3).cast("int"), 3))


def _address(place: Column) -> Column:
    """Track and sector, two bytes, of a sector counted through the disk."""
    both = [t * 256 + s for t, n in enumerate(SECTORS, 1) for s in range(n)]
    return packed(_from(both, place), 2, "big")


def _ordinals(files: DataFrame) -> DataFrame:
    """(k, ordinal, n, d, blocks): files of a key numbered by o. Rows are dealt by ranges, so a key with many rows has many tasks."""
    rows = files.withColumn("blocks", blocks_of(F.col("d"))).repartitionByRange("k", "o", F.xxhash64("n", "d")).sortWithinPartitions("k", "o", F.xxhash64("n", "d"))
    at = F.monotonically_increasing_id()
    rows = staged(rows.select("k", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at"), "n", "d", "blocks"), "files")
    parts = rows.groupBy("k", "part").agg(F.min("at").alias("least"), F.count("*").alias("files"))
    shifts = totals_before(parts, ["k"], "part", "files", "base").select("k", "part", (F.col("base") - F.col("least")).alias("shift"))
    return rows.alias("r").join(shifts.alias("l"), F.expr("r.k <=> l.k and r.part = l.part")).select("r.k", (F.col("at") + F.col("shift")).alias("ordinal"), "n", "d", "blocks")


def _free_map(used: Column, listed: Column) -> Column:
    """The header's counts and bits of free sectors, when the first sectors in their order are used."""
    starts = {t: sum(SECTORS[x - 1] for x in TRACKS[:i]) for i, t in enumerate(TRACKS)}
    out = []
    for t, n in enumerate(SECTORS, 1):
        order = [0, *(p - HEADER for p in LISTED)] if t == DIRECTORY else [spaced(k, n, INTERLEAVE) for k in range(n)]
        bits = [sum(1 << s for s in order[k:]) for k in range(n + 1)]
        taken = listed + 1 if t == DIRECTORY else F.greatest(F.lit(0), F.least(F.lit(n), used - starts[t]))
        out += [packed(F.lit(n) - taken, 1), packed(_from(bits, taken), 3)]
    return F.concat(*out)


def _image(sectors: pa.Scalar) -> bytearray:
    """An image from the sectors that it holds, all others zeros."""
    image = bytearray(IMAGE)
    for s in sectors.as_py():
        image[s["place"] * SECTOR : s["place"] * SECTOR + len(s["raw"])] = s["raw"]
    return image


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images from their sectors; IMAGES of them go out at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, IMAGES):
            part = batch.slice(start, IMAGES)
            yield pa.RecordBatch.from_arrays([part.column(0), gathered(_image(s) for s in part.column(1))], ["disk", "image"])
            trimmed()


def volumes(files: DataFrame, key: str, order: str, name: str, data: str) -> DataFrame:
    """(disk, image): the files of each key on as many disks as they need; disk is (key, group, number, first, piece).

    Up to MOST_FILES files in order are a group. A group's blocks are numbered through, and every CAPACITY of them are
    a disk, so a file may go on over the next one, in pieces. A disk's entries are files first, first + 1, ... of its
    key, and the first of them starts with that piece of its file. A key with any number of files and bytes is spread
    over many tasks; what meets in one row is the sectors of one disk."""
    bounded_batches(files.sparkSession)
    chosen = files.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(name).alias("n"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("d"))
    rows = _ordinals(chosen).withColumn("grp", F.floor(F.col("ordinal") / MOST_FILES))
    before = Window.partitionBy("k", "grp").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    ends = F.floor((F.col("start") + F.col("blocks") - 1) / CAPACITY)
    pieces = rows.withColumn("number", F.explode(F.sequence(F.floor(F.col("start") / CAPACITY), ends)))
    # block numbers on the disk, and from where in the file the piece takes its bytes
    first = F.greatest(F.lit(0), F.col("start") - F.col("number") * CAPACITY)
    skipped = F.greatest(F.lit(0), F.col("number") * CAPACITY - F.col("start"))
    pieces = pieces.select("k", "grp", "number", "ordinal", "n", first.alias("at"), skipped.alias("skipped"), (F.col("number") - F.floor(F.col("start") / CAPACITY)).cast("int").alias("piece"), F.least(F.col("blocks") - skipped, F.lit(CAPACITY) - first).alias("blocks"), "d")
    part = F.substring("d", (F.col("skipped") * DATA + 1).cast("int"), (F.col("blocks") * DATA).cast("int"))
    pieces = staged(pieces.withColumn("d", part), "pieces")
    disk = ["k", "grp", "number"]

    block = pieces.select(*disk, "at", "blocks", "d", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("i"))
    body = F.substring("d", F.col("i") * DATA + 1, F.lit(DATA))
    ahead = _address(_from(ORDER, F.col("at") + F.col("i") + 1))
    link = F.when(F.col("i") + 1 < F.col("blocks"), ahead).otherwise(F.concat(F.lit(b"\0"), packed(F.octet_length(body) + 1, 1)))
    sectors = block.select(*disk, _from(ORDER, F.col("at") + F.col("i")).alias("place"), F.concat(link, body).alias("raw"))

    numbered = pieces.select(*disk, F.row_number().over(Window.partitionBy(*disk).orderBy("ordinal")).alias("e"), "ordinal", "piece", "n", "at", "blocks").withColumn("e", F.col("e") - 1)
    title = F.rpad(F.hex(F.encode(F.substring("n", 1, 16), "US-ASCII")), 32, "A0")
    entry = F.concat(F.lit(bytes([PROGRAM])), _address(_from(ORDER, F.col("at"))), F.unhex(title), F.lit(bytes(9)), packed(F.col("blocks"), 2))
    slot = F.struct("e", F.hex(F.concat(entry, F.lit(b"\0\0"))).alias("x"))
    listed = numbered.groupBy(*disk, F.floor(F.col("e") / ENTRIES).alias("s")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(slot)), lambda x: x["x"]), "").alias("x"))
    about = numbered.groupBy(*disk).agg(F.sum("blocks").alias("used"), F.max(F.floor(F.col("e") / ENTRIES)).alias("last"), F.min(F.struct("ordinal", "piece")).alias("lead"))
    about = staged(about, "disks")
    listed = listed.alias("l").join(about.alias("a"), F.expr("l.k <=> a.k and l.grp = a.grp and l.number = a.number")).select("l.k", "l.grp", "l.number", "s", "x", "last")
    link = F.when(F.col("s") < F.col("last"), _address(_from(LISTED, F.col("s") + 1))).otherwise(F.lit(b"\x00\xff"))
    listed = listed.select(*disk, _from(LISTED, F.col("s")).alias("place"), F.substring(F.concat(link, F.unhex("x")), 1, SECTOR).alias("raw"))
    label = F.rpad(F.hex(F.encode(F.substring(F.concat(F.lit("DISK "), F.coalesce(F.col("k").cast("string"), F.lit(""))), 1, 16), "US-ASCII")), 36, "A0")
    header = F.concat(F.lit(bytes([DIRECTORY, 1, 0x41, 0])), _free_map(F.col("used"), F.col("last") + 1), F.unhex(label), F.lit(b"01\xa02A" + b"\xa0" * 4))
    headers = about.select(*disk, F.lit(HEADER).alias("place"), header.alias("raw"))

    laid = sectors.unionByName(listed).unionByName(headers).groupBy(*disk).agg(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "raw")).alias("found"))
    named = laid.alias("i").join(about.alias("a"), F.expr("i.k <=> a.k and i.grp = a.grp and i.number = a.number"))
    named = named.select(F.struct(F.col("i.k").alias("key"), F.col("i.grp").alias("group"), F.col("i.number").alias("number"), F.col("lead.ordinal").alias("first"), F.col("lead.piece").alias("piece")).alias("disk"), "found")
    return named.mapInArrow(_laid, T.StructType([named.schema["disk"]]).add("image", "binary"))


def master(files: DataFrame, key: str, order: str, name: str, data: str) -> DataFrame:
    """(key, image, fault): one image for each key; files that don't fit on one give fault `disk full` and no image."""
    made = volumes(files, key, order, name, data).groupBy(F.col("disk.key").alias(key)).agg(F.count("*").alias("_n"), F.first("image").alias("_image"))
    full = F.col("_n") > 1
    return made.select(key, F.when(~full, F.col("_image")).alias("image"), F.when(full, "disk full").alias("fault"))


def files_on(entries: DataFrame) -> DataFrame:
    """Entries of volumes with the key, and the number and piece of their file."""
    whole = F.when(F.col("entry") == 0, F.col("disk.piece")).otherwise(0)
    return entries.select(F.col("disk.key").alias("key"), (F.col("disk.first") + F.col("entry")).alias("file"), whole.alias("piece"), *(c for c in entries.columns if c not in ("disk", "entry")))


def _place(track: Column, sector: Column) -> Column:
    """A sector counted through the disk; null outside it."""
    return F.when(sector < _from(SECTORS, track - 1), _from(FIRST, track - 1) + sector).cast("long")


def sectors(disks: DataFrame, key: str, image: str) -> DataFrame:
    """(key, place, following, raw) for each sector of an image that isn't all zeros; following is null at an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.full((256, 256), -1)
        for t, n in enumerate(SECTORS, 1):
            places[t, :n] = FIRST[t - 1] + np.arange(n)

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, place, following = ([np.empty(0, np.int64)] for _ in range(3))

            def each() -> Iterator[bytes]:
                for i, raw in enumerate(batch.column(1)):
                    raw = (raw.as_py() or b"")[:IMAGE]
                    grid = np.frombuffer(raw, np.uint8, len(raw) // SECTOR * SECTOR).reshape(-1, SECTOR)
                    at = np.flatnonzero(grid.any(1))
                    row.append(np.full(len(at), i))
                    place.append(at)
                    following.append(places[grid[at, 0], grid[at, 1]])
                    yield from (grid[j].tobytes() for j in at)

            found = gathered(each())
            ahead = np.concatenate(following)
            own = batch.column(0).take(pa.array(np.concatenate(row)))
            return pa.RecordBatch.from_arrays([own, pa.array(np.concatenate(place), pa.int64()), pa.array(ahead, pa.int64(), mask=ahead < 0), found], [key, "place", "following", "raw"])

        for batch in batches:
            yield cut(batch)
            trimmed()

    bounded_batches(disks.sparkSession)
    chosen = disks.select(F.col(key).alias(key), F.col(image).cast("binary"))
    schema = T.StructType([chosen.schema[0]]).add("place", "long").add("following", "long").add("raw", "binary")
    return chosen.mapInArrow(run, schema)


def _directory(rows: DataFrame, key: str) -> DataFrame:
    start = rows.filter(F.col("place") == LISTED[0]).select(key, "place")
    chain = unroll(rows, start, [key], "place", "following", "step", SECTORS[DIRECTORY - 1])
    slots = chain.join(rows.select(key, F.col("place").alias("node"), "raw"), [key, "node"])
    each = F.transform(F.sequence(F.lit(0), F.lit(ENTRIES - 1)), lambda i: F.substring("raw", i * 32 + 1, F.lit(32)))
    slots = slots.select(key, "step", F.posexplode(each).alias("i", "slot"))
    s = F.col("slot")
    title = F.rtrim(F.translate(F.decode(F.substring("slot", F.lit(6), F.lit(16)), "ISO-8859-1"), "\xa0", " "))
    out = slots.select(key, (F.col("step") * ENTRIES + F.col("i")).alias("entry"), title.alias("name"), byte_at(s, 2).alias("kind"), byte_at(s, 3).alias("track"), byte_at(s, 4).alias("sector"), little(s, 30, 2).alias("blocks"))
    return out.filter("kind != 0 and track != 0")


def directory(disks: DataFrame, key: str, image: str) -> DataFrame:
    """(key, entry, name, kind, track, sector, blocks) for each used slot, in the directory's order. A null key has none."""
    return _directory(staged(sectors(disks, key, image), "sectors"), key)


def contents(disks: DataFrame, key: str, image: str) -> DataFrame:
    """(key, entry, data, n_blocks) of each file. A chain that loops ends after as many blocks as a disk has."""
    rows = staged(sectors(disks, key, image), "sectors")
    starts = _directory(rows, key).select(key, "entry", _place(F.col("track"), F.col("sector")).alias("place"))
    chains = unroll(rows, starts, [key], "place", "following", "step", sum(SECTORS), ["entry"])
    last = byte_at(F.col("raw"), 0) == 0
    body = F.substring("raw", F.lit(3), F.when(last, F.greatest(F.lit(0), byte_at(F.col("raw"), 1) - 1)).otherwise(DATA).cast("int"))
    found = chains.join(rows.select(key, F.col("place").alias("node"), "raw"), [key, "node"]).select(key, "entry", "step", F.hex(body).alias("x"))
    files = found.groupBy(key, "entry").agg(F.sort_array(F.collect_list(F.struct("step", "x"))).alias("b"))  # a disk's sectors at most
    return files.select(key, "entry", F.unhex(F.array_join("b.x", "")).alias("data"), F.size("b").cast("long").alias("n_blocks"))


def free_blocks(disks: DataFrame, key: str, image: str) -> DataFrame:
    """(key, free): free sectors by the bitmap, the directory's track left out."""
    img = F.col(image)
    counts = [byte_at(img, HEADER * SECTOR + 4 * t) for t in range(1, 36) if t != DIRECTORY]
    return disks.select(key, sum(counts[1:], counts[0]).alias("free"))
