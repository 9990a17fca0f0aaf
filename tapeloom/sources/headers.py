"""Fixed headers of many file formats, declared as fields; reading and writing them are column expressions.

`sniffed` names a file's format from its first bytes or its length, never from its name; `fields` gives the values of a
format's header, and `read` adds what is wrong with a file. A file that is too short for a field has null there."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.binary import big, little, packed


class Field(NamedTuple):
    """kind: u little-endian number, U big-endian number, s text, b bytes."""

    name: str
    at: int
    size: int
    kind: str = "u"


#: Fixed by the formats.
FORMATS: dict[str, list[Field]] = {
    "prg": [Field("load_address", 0, 2)],
    "p00": [Field("name", 8, 16, "s"), Field("record_size", 25, 1)],
    "atm": [Field("name", 0, 16, "s"), Field("load_address", 16, 2), Field("exec_address", 18, 2), Field("length", 20, 2)],
    "dragon_bin": [Field("file_type", 1, 1), Field("load_address", 2, 2, "U"), Field("length", 4, 2, "U"), Field("exec_address", 6, 2, "U")],
    "atr": [Field("paragraphs", 2, 2), Field("sector_size", 4, 2), Field("paragraphs_high", 6, 1)],
    "ines": [Field("prg_banks", 4, 1), Field("chr_banks", 5, 1), Field("flags6", 6, 1), Field("flags7", 7, 1)],
    "fds": [Field("sides", 4, 1)],
    "msa": [Field("sectors_per_track", 2, 2, "U"), Field("sides", 4, 2, "U"), Field("first_track", 6, 2, "U"), Field("last_track", 8, 2, "U")],
    "crt": [Field("header_length", 16, 4, "U"), Field("version", 20, 2, "U"), Field("hardware", 22, 2, "U"), Field("exrom", 24, 1), Field("game", 25, 1), Field("name", 32, 32, "s")],
    "t64": [Field("slots", 34, 2), Field("used", 36, 2), Field("name", 40, 24, "s")],
    "g64": [Field("version", 8, 1), Field("tracks", 9, 1), Field("track_size", 10, 2)],
    "tzx": [Field("major", 8, 1), Field("minor", 9, 1)],
    "uef": [Field("minor", 10, 1), Field("major", 11, 1)],
    "szx": [Field("major", 4, 1), Field("minor", 5, 1), Field("machine", 6, 1)],
    "rzx": [Field("major", 4, 1), Field("minor", 5, 1)],
    "mod": [Field("title", 0, 20, "s"), Field("orders", 950, 1), Field("magic", 1080, 4, "s")],
    "game_boy": [Field("title", 0x134, 16, "s"), Field("cartridge_type", 0x147, 1), Field("rom_size", 0x148, 1), Field("ram_size", 0x149, 1), Field("header_checksum", 0x14D, 1), Field("global_checksum", 0x14E, 2, "U")],
    "dsk": [Field("tracks", 48, 1), Field("sides", 49, 1), Field("track_size", 50, 2)],
    "sna": [Field("i", 0, 1), Field("iy", 15, 2), Field("ix", 17, 2), Field("r", 20, 1), Field("af", 21, 2), Field("sp", 23, 2), Field("interrupt_mode", 25, 1), Field("border", 26, 1)],
    "koala": [Field("load_address", 0, 2), Field("background", 10002, 1)],
}
#: (format, place, bytes): the first that matches wins.
MAGICS: list[tuple[str, int, bytes]] = [
    ("p00", 0, b"C64File\0"), ("ines", 0, b"NES\x1a"), ("fds", 0, b"FDS\x1a"), ("msa", 0, b"\x0e\x0f"), ("crt", 0, b"C64 CARTRIDGE   "), ("t64", 0, b"C64"), ("g64", 0, b"GCR-1541"),
    ("tzx", 0, b"ZXTape!\x1a"), ("uef", 0, b"UEF File!\0"), ("szx", 0, b"ZXST"), ("rzx", 0, b"RZX!"), ("atr", 0, b"\x96\x02"), ("dsk", 0, b"MV - CPC"), ("dsk", 0, b"EXTENDED"), ("mod", 1080, b"M.K."),
]
#: Formats without a magic whose files have one length.
LENGTHS = {49179: "sna", 10003: "koala"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def sniffed(content: Column) -> Column:
    """The format of a file by its magic or length; null if none is known."""
    kind = F.lit(None).cast("string")
    for length, name in LENGTHS.items():
        kind = F.when(F.octet_length(content) == length, name).otherwise(kind)
    for name, at, magic in reversed(MAGICS):
        kind = F.when(F.substring(content, at + 1, len(magic)) == F.lit(magic), name).otherwise(kind)
    return kind


def fields(content: Column, kind: str) -> Column:
    """The header of a format as a struct."""
    each = []
    for f in FORMATS[kind]:
        raw = F.substring(content, f.at + 1, f.size)
        if f.kind == "s":
            value = F.rtrim(F.translate(F.decode(raw, "ISO-8859-1"), "\0\xa0", "  "))
        elif f.kind == "b":
            value = raw
        else:
            value = (little if f.kind == "u" else big)(content, f.at, f.size)
        each.append(F.when(F.octet_length(content) >= f.at + f.size, value).alias(f.name))
    return F.struct(*each)


def fault(content: Column, kind: str) -> Column:
    """What is wrong with a file as one of a format: `no content`, `wrong magic`, `too short`, or null."""
    ends = max(f.at + f.size for f in FORMATS[kind])
    magics = [F.substring(content, at + 1, len(magic)) == F.lit(magic) for name, at, magic in MAGICS if name == kind]
    right = F.lit(not magics)
    for m in magics:
        right = right | m
    return F.when(content.isNull(), "no content").when(~right, "wrong magic").when(F.octet_length(content) < ends, "too short")


def read(files: DataFrame, content: str, kind: str, mode: str = "PERMISSIVE") -> DataFrame:
    """files with header (the format's fields) and fault. As in Spark's own sources, PERMISSIVE keeps faulty files with
    the fields that are there, DROPMALFORMED leaves them out, and FAILFAST fails the job with the first one."""
    wrong = fault(F.col(content), kind)
    out = files.withColumn("header", fields(F.col(content), kind)).withColumn("fault", wrong)
    if mode == "DROPMALFORMED":
        return out.filter("fault is null")
    if mode == "FAILFAST":
        message = F.concat(F.lit(f"not a file of format {kind}: "), wrong)
        return out.withColumn("fault", F.when(wrong.isNotNull(), F.raise_error(message).cast("string")))
    if mode != "PERMISSIVE":
        raise ValueError(f"mode {mode}")
    return out


def header(values: dict[str, Column], kind: str) -> Column:
    """The bytes of a header: the format's magic and the given fields, zeros elsewhere. Texts are cut or padded with zeros."""
    parts = [(at, len(m), F.lit(m)) for name, at, m in MAGICS if name == kind][:1]
    for f in FORMATS[kind]:
        if f.name in values:
            v = values[f.name]
            raw = F.unhex(F.rpad(F.hex(F.encode(v, "ISO-8859-1")), 2 * f.size, "0")) if f.kind == "s" else packed(v, f.size, "little" if f.kind == "u" else "big")
            parts.append((f.at, f.size, raw))
    out, at = [], 0
    for place, size, raw in sorted(parts, key=lambda p: p[0]):
        if place < at:
            raise ValueError(f"fields of {kind} overlap at {place}")
        out += [F.lit(bytes(place - at)), raw]
        at = place + size
    return F.concat(*out)
