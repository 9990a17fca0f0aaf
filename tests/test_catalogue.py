import pytest
from conftest import DATA

from tapeloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, same_rows, name):
    same_rows(catalogue.QUERIES[name](spark, DATA), duck.execute(catalogue.ORACLES[name]))


@pytest.mark.parametrize("name", ["disk_directories", "disk_files", "disk_free_blocks"])
def test_long_conversations_take_several_disks(spark, same_rows, tmp_path, name):
    import duckdb

    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    kind = dict(turns.dtypes)
    first = turns.first().conv_id
    odd = [(first, 10_000 + i, "user", "x" * (i * 37)) for i in range(400)] + [(first, 20_000 + i, "user", "yz" * n) for i, n in enumerate([200_000, 84_328, 84_329, 3])]
    more = spark.createDataFrame(odd, f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, text string")
    turns.limit(50).select("conv_id", "turn", "role", "text").union(more).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    same_rows(catalogue.QUERIES[name](spark, str(tmp_path)), duck.execute(catalogue.ORACLES[name]))


def test_full_directory_sectors_stay_inside_theirs(spark):
    """Sectors of a disk come in any order; one with eight entries once wrote its last two bytes over the next one."""
    from pyspark.sql import functions as F

    from tapeloom.sources import disks

    files = spark.range(40 * 144).select((F.col("id") % 40).alias("k"), F.floor(F.col("id") / 40).alias("o"), F.concat(F.lit("F"), "id").alias("n"), F.lit(b"x" * 300).alias("d"))
    entries = disks.files_on(disks.directory(disks.volumes(files, "k", "o", "n", "d"), "disk", "image"))
    assert {(r.key, r.file) for r in entries.collect()} == {(k, o) for k in range(40) for o in range(144)}


@pytest.mark.parametrize("name", ["disk_files", "disk_directories", "disk_free_blocks", "block_checksums", "checksum_summary", "codec_round_trips", "chunk_layouts"])
def test_batches_of_bytes_are_bounded(spark, name):
    """Python workers get at most a few MB at a time, however many rows there are."""
    from pyspark.sql import functions as F

    for c in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{c}")
    catalogue.QUERIES[name](spark, DATA)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(0, 400, 1, 1).select(F.expr("cast(repeat('x', 100000) as binary)").alias("b"))
    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 8 << 20


def test_images_leave_a_worker_a_few_at_a_time():
    import pyarrow as pa

    from tapeloom.sources import disks

    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[{"place": 1, "raw": bytes([i])}] for i in range(100)])], ["disk", "found"])
    out = list(disks._laid(iter([batch])))
    assert max(b.num_rows for b in out) <= disks.IMAGES and sum(b.num_rows for b in out) == 100
    assert [x.as_py()[256] for b in out for x in b.column(1)] == list(range(100))


def test_declared_sizes_rounds_halves_as_its_sql(spark, same_rows, tmp_path):
    import duckdb

    prices = [-30_000.0, -10_000.0, 10_000.0, 29_999.99, 30_000.0, 50_000.0, 70_000.0, 150_000.0, None]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, line) for k in range(len(prices)) for line in range(k % 4)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("orders", "lineitem"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    same_rows(catalogue.QUERIES["declared_sizes"](spark, str(tmp_path)), duck.execute(catalogue.ORACLES["declared_sizes"]))


def test_texts_beyond_the_default_bound_come_back(spark):
    from pyspark.sql import functions as F

    from tapeloom.functions import codecs

    raw = spark.range(1).select(F.repeat(F.lit("ab" * 1024 + "c" * 1024), 6000).cast("binary").alias("raw"))
    for codec in codecs.ENCODERS:
        encoded = codecs.encode(F.col("raw"), codec)
        r = raw.select((codecs.decode(encoded, codec, F.octet_length("raw"))["value"] == F.col("raw")).alias("same"), codecs.decode(encoded, codec)["fault"].alias("fault")).first()
        assert r.same and r.fault == "too long"


def test_crc_of_files_is_that_of_zlib(spark):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in catalogue.QUERIES["crc_of_files"](spark, DATA).collect():
        assert r.crc == zlib.crc32((texts[r.doc_id] or "").encode())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_header_fields_runs_as_compiled_code(spark, capsys):
    """The JVM interprets methods of more than 8000 bytes; all headers in one row once made one of 31,784."""
    import re

    catalogue.QUERIES["header_fields"](spark, DATA).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
