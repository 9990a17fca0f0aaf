import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 9)
    return x


@pytest.fixture(scope="session")
def same_rows():
    """Rows of a Spark DataFrame and a DuckDB result are equal, whatever their order."""

    def compare(df, cursor):
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        mine = sorted((tuple(map(_plain, (r[c] for c in order))) for r in df.collect()), key=repr)
        theirs = sorted((tuple(map(_plain, (r[names.index(c)] for c in order))) for r in cursor.fetchall()), key=repr)
        assert mine == theirs

    return compare
