"""Fixed layouts inside a file: cells of a tracker's pattern, attributes of a screen, addresses on a disk, sets of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.binary import big

CHANNELS, CELL, ROWS = 4, 4, 64


def notes(patterns: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """(keys, row, channel, sample, period, effect, parameter) for each cell of a pattern of 1024 bytes."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(ROWS * CHANNELS - 1)), lambda i: F.substring(F.col(pattern), i * CELL + 1, F.lit(CELL)))
    rows = patterns.select(*keys, F.posexplode(cells).alias("cell", "raw")).withColumn("word", big(F.col("raw"), 0, CELL))
    w = F.col("word")
    sample = F.shiftright(w, 28).bitwiseAND(15) * 16 + F.shiftright(w, 12).bitwiseAND(15)
    return rows.select(*keys, F.floor(F.col("cell") / CHANNELS).alias("row"), (F.col("cell") % CHANNELS).cast("long").alias("channel"), sample.alias("sample"), F.shiftright(w, 16).bitwiseAND(4095).alias("period"), F.shiftright(w, 8).bitwiseAND(15).alias("effect"), w.bitwiseAND(255).alias("parameter"))


def attribute(byte: Column) -> Column:
    """Colours of a character cell: ink, paper, bright, flash."""
    bits = lambda at, mask: F.shiftright(byte, at).bitwiseAND(mask)
    return F.struct(bits(0, 7).alias("ink"), bits(3, 7).alias("paper"), bits(6, 1).alias("bright"), bits(7, 1).alias("flash"))


def address(block: Column, sectors: list[int]) -> Column:
    """(track, sector) of a block on a disk with so many sectors on each track; tracks from 1. Null outside the disk."""
    first = [sum(sectors[:t]) for t in range(len(sectors))]
    starts = F.array(*(F.lit(n).cast("long") for n in first))
    track = F.size(F.filter(starts, lambda s: s <= block)).cast("long")
    inside = (block >= 0) & (block < sum(sectors))
    return F.when(inside, F.struct(track.alias("track"), (block - F.element_at(starts, track.cast("int"))).alias("sector")))


def sets(files: DataFrame, keys: list[str], role: str, needed: list[str]) -> DataFrame:
    """(keys, files, missing, repeated) for each set of files: roles that no file has, and that more than one has.

    Roles are counted before sets, so a set of very many files is counted by many tasks."""
    counted = files.groupBy(*keys, F.col(role).alias("_role")).agg(F.count("*").alias("_n"))
    roles = F.collect_set(F.when(F.col("_role").isin(*needed), F.col("_role")))
    twice = F.collect_set(F.when(F.col("_n") > 1, F.col("_role")))
    out = counted.groupBy(*keys).agg(F.sum("_n").alias("files"), roles.alias("_r"), twice.alias("_t"))
    missing = F.array_except(F.array(*map(F.lit, needed)), F.col("_r"))
    return out.select(*keys, "files", F.array_join(F.array_sort(missing), ",").alias("missing"), F.array_join(F.array_sort("_t"), ",").alias("repeated"))
