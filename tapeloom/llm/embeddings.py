"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one kept vector for each component.

Vectors of equal label are compared by cosine in double precision. Equal vectors form a class, whose smallest id stands
for them. Spherical k-means, fitted on a bounded sample, makes as many cells as the largest label has CELL_ROWS classes;
each class goes to the PROBES cells whose centres are nearest, and classes of a label are compared where they share a
cell. So a class is copied PROBES times at any number of cells, and with k cells PROBES ** 2 / k of all pairs are
compared. A pair is counted in the smallest cell that both are in, so no link is counted twice.

Cells decide which pairs are looked at, and every pair is confirmed by its cosine: no link below the threshold is made.
A link may be missed if the nearest cells of its two ends are all different; the README has the recall measured against
exact=True, which compares all pairs of a label. Clusters of copies, whose cells agree, lose nothing of their component.

Cells are compared in blocks of at most BLOCK classes, each pair of blocks as one matrix product, so a cell that holds
most rows is spread over many tasks. A pair of blocks returns a row for each class that has links in it: their number,
and an edge to the root of its links there.

Defined cases: a vector that is null, zero, or holds null or non-finite components links with nothing, and neither does
one with a null label; it is its own component and kept. Vectors of different lengths don't link. Repeated rows are
vectors of their own and link with each other. A row with a null id links with nothing and has a null component. Equally
near centres are taken in their order. Other columns aren't read, so their names may be any. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected, groups, written

THRESHOLD = 0.93
BLOCK = 192
#: Classes of the largest label for each cell, the most cells, the cells of a class, and the most vectors (and bytes) that
#: the centres are fitted on. Beyond MAX_CELLS cells grow with the table.
CELL_ROWS = 32
MAX_CELLS = 1024
PROBES = 3
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 32 << 20
ROUNDS = 12
#: Up to so many sizes of cells are broadcast (40 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes and the digest of each usable vector, as doubles."""
    for batch in batches:
        ids, labels, lists = batch.columns
        digests: list[bytes | None] = []
        vectors: list[bytes | None] = []
        sizes: list[int | None] = []
        for label, row in zip(labels.to_pylist(), lists, strict=True):
            x = np.empty(0) if label is None or not row.is_valid else row.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            usable = len(x) and np.isfinite(x).all() and x.any()
            raw = x.tobytes() if usable else None
            vectors.append(raw)
            digests.append(raw and xxhash.xxh3_128_digest(raw))
            sizes.append(len(x) if usable else None)
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["id", "label", "size", "digest", "vector"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components would leave the range of doubles
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres by spherical k-means; a start far from the others comes first, an empty cell keeps its centre."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    c = sample[chosen].copy()
    for _ in range(ROUNDS):
        home = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The cells of each unit vector: those of the nearest centres."""
    near = -(x @ c.T)
    if probes >= len(c):
        return np.broadcast_to(np.arange(len(c)), near.shape)
    return np.argsort(near, axis=1, kind="stable")[:, :probes]


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["label", "size", "cell", "i", "j"]):
            side = np.array(rows.column("side").to_pylist())
            ids, n = (np.array(rows.column(k).to_pylist(), np.int64) for k in ("id", "n"))
            x, cells = _unit(rows.column("vector").to_pylist()), np.array(rows.column("cells").to_pylist())
            cell, own = rows.column("cell")[0].as_py(), rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            left, right = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            on = x[left] @ x[right].T >= threshold
            u, v = np.nonzero(on)
            # a pair with a smaller cell in common is counted there
            mine, theirs = cells[left[u]], cells[right[v]]
            on[u, v] = ~((mine[:, :, None] == theirs[:, None, :]) & (mine[:, :, None] < cell)).any((1, 2))
            if own:
                np.fill_diagonal(on, False)
            links = np.zeros(len(ids), np.int64)
            links[left] += on @ n[right]
            if not own:
                links[right] += on.T @ n[left]
            root = np.arange(len(ids))
            while True:  # the smallest row reached over links
                before = root.copy()
                np.minimum.at(root, left, np.where(on, root[right][None], len(ids)).min(1, initial=len(ids)))
                np.minimum.at(root, right, np.where(on, root[left][:, None], len(ids)).min(0, initial=len(ids)))
                root = root[root]
                if (root == before).all():
                    break
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[root[at]])], ["id", "n_links", "root"])

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of vectors; key must hold whole numbers."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    ready = written(rows.mapInArrow(_prepared, "id long, label string, size int, digest binary, vector binary"), "vectors")
    known = ready.filter("id is not null and digest is not null")
    classes = known.groupBy("label", "digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("vector").alias("vector"))
    classes = written(classes, "classes")

    count = classes.count()
    largest = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    common = classes.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = common[0]["size"] if common else 1
    take = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * size)))
    sample = classes.filter(F.col("size") == size).select("vector").orderBy(F.xxhash64("digest"), "vector").limit(take).collect()
    k = 1 if exact else max(1, min(MAX_CELLS, -(-largest // cell_rows)))
    middle = centres(_unit([r.vector for r in sample]), k) if sample else np.zeros((1, size))
    probes = min(probes, len(middle))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.array(batch.column(2).to_pylist(), np.int64) == size
            cells = np.zeros((len(fits), probes), np.int32)  # vectors of another length are all in cell 0
            at = np.flatnonzero(fits)
            if len(at):
                cells[at] = cells_of(_unit(batch.column(4).take(pa.array(at)).to_pylist()), middle, probes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(cells.tolist(), pa.list_(pa.int32()))], ["id", "label", "size", "n", "vector", "cells"])

    dealt = classes.select("id", "label", "size", "n", "vector").mapInArrow(assign, "id long, label string, size int, n long, vector binary, cells array<int>")
    dealt = written(dealt, "cells").withColumn("cell", F.explode(F.array_distinct("cells")))
    blocks = written(dealt.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    if blocks.count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    dealt = dealt.join(blocks, ["label", "size", "cell"]).withColumn("b", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int"))
    deals = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(b, o) as i, greatest(b, o) as j, int(b > o) as side))")  # each pair of blocks once
    keys = ["label", "size", "cell", "i", "j"]
    dealt = dealt.select("label", "size", "cell", "cells", F.explode(deals).alias("deal"), "id", "n", "vector").select("label", "size", "cell", "deal.*", "cells", "id", "n", "vector")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 10_000)
    found = written(dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "id long, n_links long, root long"), "links")
    # ids are unique to a class unless rows of one id hold different vectors; then their links add up
    links = found.groupBy("id").agg(F.sum("n_links").alias("more"))
    reached = connected(found.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("label", "digest", "id", "n").join(links, "id", "left").join(reached, "id", "left")
    named = named.select("label", "digest", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    out = ready.select("id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.coalesce(F.when(F.col("id").isNotNull(), F.col("links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
