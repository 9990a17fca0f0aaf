"""Linked blocks: walking chains and finding their ends, lengths and loops, for all files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.staging import staged


def walk(links: DataFrame, keys: list[str], node: str, following: str) -> DataFrame:
    """(keys, node, steps, loops) for each block: blocks after it to the end of its chain, or whether the chain loops.

    links has one row for each block (of repeated rows one counts), following null at an end, or naming a block that
    isn't there. Pointers double in each round, so chains of n blocks take log2(n) rounds of one join, and a chain that still goes on after as many
    steps as there are blocks loops. Nothing is walked block by block, and no task holds a file."""
    # written before it is joined with itself, so that a task doesn't hold the tables of both sides
    here = staged(links.groupBy(*keys, F.col(node).alias("node")).agg(F.min(following).alias("to")), "blocks")
    there = here.select(*keys, F.col("node").alias("to"), F.lit(True).alias("known"))
    state = here.join(there, [*keys, "to"], "left").select(*keys, "node", F.when(F.col("known"), F.col("to")).alias("to"))
    state = staged(state.withColumn("steps", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")), "chain")
    longest = state.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < longest and state.filter("to is not null").limit(1).count():
        ahead = state.select(*keys, F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        moved = state.filter("to is not null").join(ahead, [*keys, "to"], "left").select(*keys, "node", F.col("beyond").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        state = staged(moved.unionByName(state.filter("to is null")), "chain")
        reach *= 2
    loops = F.col("to").isNotNull()
    return state.select(*keys, F.col("node").alias(node), F.when(~loops, F.col("steps")).alias("steps"), loops.alias("loops"))


def unroll(links: DataFrame, starts: DataFrame, keys: list[str], node: str, following: str, out: str, most: int, carried: list[str] | None = None) -> DataFrame:
    """(keys, carried, out, node) for each block of each chain that starts at a row of starts, numbered from 0 by out.

    links has one row for each block. Jumps double in each round, and so does what is known of every chain: a chain of n
    blocks takes log2(n) rounds of two joins. A chain that loops ends after most blocks; a block that isn't there ends it too."""
    carried = carried or []
    jumps = links.select(*keys, F.col(node).alias("node"), F.col(following).alias("to"))
    found = starts.select(*keys, *carried, F.lit(0).cast("long").alias(out), F.col(node).alias("node")).join(links.select(*keys, F.col(node).alias("node")), [*keys, "node"], "left_semi")
    found = staged(found.select(*keys, *carried, out, "node"), "chains")
    reach = 1
    while reach < most:
        ahead = found.join(jumps.filter("to is not null"), [*keys, "node"]).select(*keys, *carried, (F.col(out) + reach).alias(out), F.col("to").alias("node"))
        ahead = ahead.filter(F.col(out) < most).join(links.select(*keys, F.col(node).alias("node")), [*keys, "node"], "left_semi").select(*keys, *carried, out, "node")
        ahead = staged(ahead, "chains")
        if ahead.isEmpty():
            break
        found = found.unionByName(ahead)
        reach *= 2
        further = jumps.select(*keys, F.col("node").alias("to"), F.col("to").alias("beyond"))
        jumps = staged(jumps.join(further, [*keys, "to"], "left").select(*keys, "node", F.col("beyond").alias("to")), "jumps")
    return found
