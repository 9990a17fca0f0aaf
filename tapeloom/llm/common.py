"""Helpers shared by the operators: scratch tables, batch bounds, grouping, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.staging import bounded_batches, dropped, fresh, scratch, totals_before, trimmed
from tapeloom.plans.staging import staged as written

__all__ = ["bounded_batches", "connected", "dropped", "fresh", "groups", "scratch", "tidy", "totals_before", "trimmed", "written"]


def tidy(run):
    """run, but what its task has freed goes back to the system."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trimmed()

    return inner


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from the batches of a partition that is sorted by keys.

    Only the rows of one key are held at a time, besides one batch."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start, current = 0, None
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
            current = key
        if batch.num_rows > start:
            held.append(batch.slice(start))
        last = current
    if held:
        yield pa.Table.from_batches(held)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (id, component), component the smallest id reached.

    Each round sends the smallest known label over every edge and then jumps to the label's own label, so the
    number of rounds grows with the logarithm of the diameter. Labels reach an id by partial minima, and a label that
    many ids share is looked up once and joined back by AQE's split of skewed keys. Every round is a written table,
    the one before it is deleted; nothing but a count of changes comes to the driver. Ids without an edge aren't
    returned; self edges return the id alone."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    both = written(both.union(both.select("b", "a")).distinct(), "edges")
    state = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")).withColumn("was", F.col("id")), "labels")
    while not state.filter("component < was").isEmpty():
        labels = state.select("id", "component")
        sent = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        near = labels.join(sent, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("near"))
        far = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        moved = written(near.join(far, "near").select("id", F.least("near", "far").alias("component"), "was"), "labels")
        dropped(state)
        state = moved
    dropped(both)
    return state.select("id", "component")
