"""Images that arrive in a folder, as a stream: each file is read once, split or described, and written on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources import headers, streams

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_each: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of files as they come; a micro-batch takes files_each at most."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_each).load(folder)


def chunks(files: DataFrame, layout: streams.Layout) -> DataFrame:
    """The chunks of arriving files."""
    return streams.split(files, ["path"], "content", layout)


def census(files: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Files and bytes of each format by the time they were made; a file later than that is left out of closed windows."""
    kinds = files.select("modificationTime", "length", F.coalesce(headers.sniffed(F.col("content")), F.lit("unknown")).alias("format"))
    return kinds.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), "format").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
