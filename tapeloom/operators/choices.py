"""Choosing one of several readings of an image: best score, first that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.binary import little

#: Tracks in the order of preference, sectors of a track, sides.
TRACKS = [*range(80, 85), *range(79, 0, -1), 85, 86]
SECTORS = [9, 10, 11, 12]
SIDES = [2, 1]
SECTOR = 512


def best(candidates: dict[int, Column], least: int = 0) -> Column:
    """(offset, score) of the highest score above least; a tie goes to the lowest offset. Null if none is above.

    The candidates are columns of one row, so nothing is shuffled."""
    each = F.array(*(F.struct((-score).alias("order"), F.lit(offset).cast("long").alias("offset"), score.alias("score")) for offset, score in candidates.items()))
    fit = F.filter(each, lambda c: c["score"] > least)
    return F.array_min(fit)


def geometries(spark: SparkSession) -> DataFrame:
    """All geometries with their rank: those of a size first in the order of preference. 688 rows."""
    rows = [(rank, t, sides, s, t * sides * s * SECTOR) for rank, (t, s, sides) in enumerate((t, s, sides) for t in TRACKS for s in SECTORS for sides in SIDES)]
    return spark.createDataFrame(rows, "rank int, tracks long, sides long, sectors_per_track long, size long")


def fit_geometry(images: DataFrame, size: str) -> DataFrame:
    """images with the first geometry that covers their whole sectors exactly; null where none does."""
    first = geometries(images.sparkSession).groupBy("size").agg(F.min_by(F.struct("tracks", "sides", "sectors_per_track"), "rank").alias("geometry"))
    whole = F.col(size) - F.col(size) % SECTOR
    return images.withColumn("_whole", whole).join(F.broadcast(first.withColumnRenamed("size", "_whole")), "_whole", "left").drop("_whole")


def boot_geometry(boot: Column) -> Column:
    """(tracks, sides, sectors_per_track) that a boot sector declares; null if it can't be a disk's."""
    sector, total, per_track, sides = (little(boot, at, 2) for at in (0x0B, 0x13, 0x18, 0x1A))
    cylinder = F.when(sides * per_track > 0, sides * per_track)
    fits = (F.octet_length(boot) >= SECTOR) & (sector == SECTOR) & sides.between(1, 2) & per_track.between(8, 12) & (total > 0) & (total % cylinder == 0)
    tracks = F.floor(total / cylinder)
    return F.when(fits & tracks.between(1, 86), F.struct(tracks.alias("tracks"), sides.alias("sides"), per_track.alias("sectors_per_track")))


def geometry_of(images: DataFrame, boot: str, size: str) -> DataFrame:
    """images with geometry: the boot sector's if it covers the whole sectors exactly, else one that the size fits, else
    the boot sector's if it isn't larger than the image; null where none is."""
    declared = images.withColumn("_boot", boot_geometry(F.col(boot)))
    fitted = fit_geometry(declared, size)
    covered = F.col("_boot.tracks") * F.col("_boot.sides") * F.col("_boot.sectors_per_track") * SECTOR
    exact = covered == F.col(size) - F.col(size) % SECTOR
    chosen = F.when(exact, F.col("_boot")).when(F.col("geometry").isNotNull(), F.col("geometry")).when(covered <= F.col(size), F.col("_boot"))
    return fitted.withColumn("geometry", chosen).drop("_boot")


def pairs(files: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, index, even, odd): each odd-numbered file with the even-numbered one that follows it."""
    first = files.filter(F.col(index) % 2 == 1).select(*keys, F.col(index), F.col(value).alias("even"))
    second = files.filter(F.col(index) % 2 == 0).select(*keys, (F.col(index) - 1).alias(index), F.col(value).alias("odd"))
    return first.join(second, [*keys, index])
