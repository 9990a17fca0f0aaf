"""Ordered records of a file: carried values, next boundaries, running places, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def repeat_last(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """A null value repeats the last one before it, as a frame that says 'same as before' does."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def carry_header(df: DataFrame, keys: list[str], order: list[str], is_header: Column, size: Column, out: str) -> DataFrame:
    """The size that the header just before gives a record; null if the record before isn't a header."""
    w = _ordered(keys, order)
    return df.withColumn(out, F.when(~is_header & F.lag(is_header, 1, False).over(w), F.lag(size).over(w)))


def next_boundary(df: DataFrame, keys: list[str], offset: str, end: Column, out: str) -> DataFrame:
    """The smallest larger offset of the same file, or its end: where a payload without a length must stop.

    Distinct offsets look one row ahead and are joined back, so the work is linear in a file's entries."""
    places = df.select(*keys, offset).distinct()
    stops = places.withColumn("_stop", F.lead(offset).over(_ordered(keys, [offset])))
    same = " and ".join(f"l.`{c}` <=> s.`{c}`" for c in (*keys, offset))
    joined = df.alias("l").join(stops.alias("s"), F.expr(same), "left")
    return joined.select("l.*", F.col("_stop")).withColumn(out, F.coalesce("_stop", end)).drop("_stop")


def running_start(df: DataFrame, keys: list[str], order: list[str], size: Column, out: str, base: int = 0) -> DataFrame:
    """Where a record starts when all records before it are laid down from base on."""
    before = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.lit(base) + F.coalesce(F.sum(size).over(before), F.lit(0)))


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, run, value, length): run-length encoding, runs numbered from 0."""
    w = _ordered(keys, order)
    starts = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long"), F.lit(1))
    marked = df.withColumn("_new", starts).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def unrolled(encoded: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, place, value): the records again, places numbered from 0."""
    placed = running_start(encoded, keys, ["run"], F.col("length"), "start")
    return placed.select(*keys, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place"), value)
