"""Written tables that end a lineage, and running totals that no single task holds."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper bounds of one Arrow batch sent to a Python worker.
BATCH_ROWS = 4096
BATCH_BYTES = 4 << 20
#: Orders whose values are summed before the sums of earlier ones are added.
CHUNK = 1000


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Keep Arrow batches small, so that long values don't fill a Python worker; without a session, in the active one."""
    spark = spark or SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimmed() -> None:
    """Give what is free back to the system: Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tapeloom-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Where it is unset a local master, as in tests, gets a temporary folder; on a cluster nobody else could read that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: the lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def totals_before(parts: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """parts with the sum of value over the rows of the same group with a smaller order (a whole number).

    Sums of CHUNK orders at a time are summed first, so no task sees more than a thousandth of a group's rows."""
    chunk = fresh(parts, "chunk")
    inside = parts.withColumn(chunk, F.floor(F.col(order) / CHUNK))
    window = Window.partitionBy(*by)
    chunks = inside.groupBy(*by, chunk).agg(F.sum(value).alias("all")).withColumn("ahead", F.sum("all").over(window.orderBy(chunk)) - F.col("all"))
    inside = inside.withColumn("base", F.sum(value).over(Window.partitionBy(*by, chunk).orderBy(order)) - F.col(value))
    same = " and ".join(f"i.`{c}` <=> c.`{c}`" for c in (*by, chunk))
    return inside.alias("i").join(chunks.alias("c"), F.expr(same)).select(*(F.col(f"i.`{c}`").alias(c) for c in parts.columns), (F.col("base") + F.col("ahead")).alias(out))
