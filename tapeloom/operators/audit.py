"""Consistency checks of a block device as joins: bitmap against use, owners, pointer tables, declared sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def used_but_free(used: DataFrame, bitmap: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks in use that the bitmap (keys, free) marks free."""
    return used.select(*keys).distinct().join(bitmap.filter("free").select(*keys), keys, "left_semi")


def allocated_but_unused(used: DataFrame, bitmap: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that the bitmap marks taken and nothing reaches."""
    return bitmap.filter("not free").select(*keys).join(used.select(*keys), keys, "left_anti")


def contested(used: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """(keys, owners): blocks with more than one owner, and how many. Owners are counted in two steps, so a block
    that very many files claim is counted by many tasks."""
    return used.select(*keys, owner).distinct().groupBy(*keys).agg(F.count("*").alias("owners")).filter("owners > 1")


def out_of_order(blocks: DataFrame, file: str, pointer: str, chain: str, block: str) -> DataFrame:
    """(file, n_blocks, first_wrong): files whose blocks by place in the pointer table differ from those by place in
    the chain; first_wrong is the first place where they do. Both orders are numbered and joined, no file is collected."""
    by = Window.partitionBy(file)
    table = blocks.select(file, F.row_number().over(by.orderBy(pointer, block)).alias("_at"), F.col(block).alias("_t"))
    walked = blocks.select(file, F.row_number().over(by.orderBy(chain, block)).alias("_at"), F.col(block).alias("_w"))
    wrong = F.when(F.col("_t") != F.col("_w"), F.col("_at") - 1)
    both = table.join(walked, [file, "_at"]).groupBy(file).agg(F.count("*").alias("n_blocks"), F.min(wrong).cast("long").alias("first_wrong"))
    return both.filter("first_wrong is not null")


def size_faults(files: DataFrame, blocks: DataFrame, file: str, declared: str, held: str) -> DataFrame:
    """(file, declared, held, fault): fault is short, long or none; a file without blocks holds 0."""
    found = blocks.groupBy(file).agg(F.sum(held).alias("_held"))
    size = F.coalesce("_held", F.lit(0))
    fault = F.when(size < F.col(declared), "short").when(size > F.col(declared), "long").otherwise("none")
    return files.join(found, file, "left").select(file, F.col(declared).alias("declared"), size.alias("held"), fault.alias("fault"))


def verdicts(blocks: DataFrame, file: str, place: str, valid: Column) -> DataFrame:
    """(file, n_blocks, valid, first_bad): whether all checksums of a file hold, and the first block whose doesn't."""
    return blocks.groupBy(file).agg(F.count("*").alias("n_blocks"), F.bool_and(valid).alias("valid"), F.min(F.when(~valid, F.col(place))).alias("first_bad"))


def repeated_names(entries: DataFrame, directory: str, name: str) -> DataFrame:
    """(directory, folded, entries): names that a directory holds twice or more, case folded."""
    return entries.groupBy(directory, F.upper(name).alias("folded")).agg(F.count("*").alias("entries")).filter("entries > 1")


def look_up(requests: DataFrame, entries: DataFrame, directory: str, name: str) -> DataFrame:
    """requests with the entry of their directory that has their name, case folded; null where there is none."""
    folded = fold_names(entries, directory, name)
    return requests.withColumn("_folded", F.upper(name)).join(folded, [directory, "_folded"], "left").drop("_folded")


def fold_names(entries: DataFrame, directory: str, name: str) -> DataFrame:
    """The first entry of each case-folded name: whole, and the smallest by its columns in their order."""
    rest = [c for c in entries.columns if c not in (directory, name)]
    first = entries.groupBy(directory, F.upper(name).alias("_folded")).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(directory, "_folded", "_first.*")
