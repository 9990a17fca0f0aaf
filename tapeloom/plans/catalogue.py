"""All queries of the engine's own operators, with the SQL that gives the same rows.

The tables hold no images, so each query makes an operator's input from their rows: texts are files of bytes, orders
are files and their lines blocks, parts are blocks of a device and names in directories, events and conversations
are streams of records. Every query reads its tables whole."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import basic, codecs
from tapeloom.functions import binary as B
from tapeloom.operators import audit, chains, choices, layouts, rasters, sequences
from tapeloom.plans.staging import bounded_batches
from tapeloom.sources import disks, headers, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(text: str) -> F.Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


#: The bytes bs of each text as a list of n numbers.
_BYTES = """
h AS (SELECT doc_id, lang, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, lang, len(h) // 2 AS n, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bs FROM h)
"""

_SUMS = (
    _BYTES
    + """,
f AS (
    SELECT doc_id, lang, n, coalesce(list_aggregate(bs, 'bit_xor'), 0) AS parity, CAST(coalesce(list_sum(bs), 0) AS BIGINT) AS total,
        CAST(coalesce(list_sum(list_transform(bs, lambda b, i: (n - i + 1) * b)), 0) AS BIGINT) AS weighted,
        CAST(coalesce(list_sum(list_transform(bs, lambda b, i: b << (8 * (3 - (i - 1) % 4)))), 0) AS BIGINT) AS words
    FROM bytes
)
"""
)


def _pieces(digits: int) -> str:
    """Blocks x, numbered s from 0, of the hexadecimal digits of each text."""
    return f"""
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, unnest(list_transform(range((len(h) + {digits - 1}) // {digits}), lambda s: {{'s': s, 'x': substring(h, {digits} * s + 1, {digits})}})) AS p FROM h),
sectors AS (SELECT doc_id, p.s AS s, p.x AS x FROM pieces)
"""


@query(
    f"""WITH {_SUMS}
SELECT lang, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes, bit_xor(parity) AS parity, CAST(sum(total % 256) AS BIGINT) AS sum8,
    CAST(sum(total % 255) AS BIGINT) AS sector_sum
FROM f GROUP BY lang"""
)
def checksum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.figures(_bytes("text"))
    docs = table(spark, sf_dir, "documents").select("lang", f.alias("f"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("files"), F.sum("f.n").alias("bytes"), F.bit_xor("f.parity").alias("parity"), F.sum(B.sum8(F.col("f"))).alias("sum8"), F.sum(B.sector_sum(F.col("f"))).alias("sector_sum")
    )


@query(
    f"""WITH {_SUMS}
SELECT doc_id, n, parity, total % 256 AS sum8, total % 65536 AS sum16, (256 - (total + n) % 256) % 256 AS header_sum, total % 255 AS sector_sum,
    (4294967296 - words % 4294967296) % 4294967296 AS longword_sum,
    4294967295 - CASE WHEN words = 0 THEN 0 ELSE (words - 1) % 4294967295 + 1 END AS boot_sum,
    (n + weighted) % 65521 * 65536 + (1 + total) % 65521 AS adler32
FROM f"""
)
def block_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", B.figures(_bytes("text")).alias("f"))
    f = F.col("f")
    sums = {"sum8": B.sum8, "sum16": B.sum16, "header_sum": B.header_sum, "sector_sum": B.sector_sum, "longword_sum": B.longword_sum, "boot_sum": B.boot_sum, "adler32": B.adler32}
    return docs.select("doc_id", "f.n", "f.parity", *(fn(f).cast("long").alias(name) for name, fn in sums.items()))


@query(
    f"""WITH {_BYTES},
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bs), lambda a, b: xor(a >> 8, entries[xor(a & 255, b) + 1])), 4294967295) AS crc FROM bytes, t"""
)
def crc_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 by the built-in function (its check value is in the tests)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(_bytes("text")).alias("crc"))


@query(
    f"""WITH {_BYTES},
sized AS (SELECT *, CASE WHEN n > 0 THEN CAST(2 ** floor(log2(n)) AS BIGINT) ELSE 0 END AS base FROM bytes),
halves AS (SELECT doc_id, n, base, coalesce(list_sum(bs[1:base]), 0) AS head, coalesce(list_sum(bs[base + 1:]), 0) AS tail FROM sized)
SELECT doc_id, CAST((head + CASE WHEN n > base THEN tail * (base // (n - base)) ELSE 0 END) % 65536 AS BIGINT) AS checksum FROM halves"""
)
def mirrored_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cartridge whose size isn't a power of two counts its rest as often as it is mirrored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _bytes("text").alias("rom")).withColumn("n", F.octet_length("rom").cast("long"))
    base = F.when(F.col("n") > 0, F.expr("shiftleft(1L, length(bin(n)) - 1)")).otherwise(0)
    docs = docs.withColumn("base", base.cast("int"))
    head = B.figures(F.substring("rom", F.lit(1), F.col("base")))["total"]
    tail = B.figures(F.expr("substring(rom, base + 1)"))["total"]
    docs = docs.select("doc_id", "n", F.col("base").cast("long").alias("base"), head.alias("head"), tail.alias("tail"))
    times = F.when(F.col("n") > F.col("base"), F.floor(F.col("base") / (F.col("n") - F.col("base")))).otherwise(0)
    return docs.select("doc_id", ((F.col("head") + F.col("tail") * times) % 65536).cast("long").alias("checksum"))


@query(
    f"""WITH {_pieces(512)},
lists AS (SELECT doc_id, s, list_transform(range(254, -1, -1), lambda i: coalesce(CAST('0x' || nullif(substring(x, CAST(2 * i + 1 AS BIGINT), 2), '') AS BIGINT), 0)) AS bs FROM sectors)
SELECT doc_id, s AS sector, list_reduce(list_prepend(255, bs), lambda a, b: (CASE WHEN a > 255 THEN a % 256 + 1 ELSE a END) + b) % 256 AS checksum
FROM lists"""
)
def map_sector_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(B.blocks(_bytes("text"), 256)).alias("s"))
    return docs.select("doc_id", F.col("s.number").cast("long").alias("sector"), B.map_sum(F.col("s.block")).alias("checksum"))


@query(
    f"""WITH {_pieces(510)}
SELECT doc_id, s AS block, len(x) // 2 AS length,
    CAST((1 + len(x) // 2 + list_sum(list_transform(regexp_extract_all(x, '..'), lambda y: CAST('0x' || y AS BIGINT)))) % 256 AS BIGINT) AS checksum
FROM sectors"""
)
def tape_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data blocks of a cassette: type, length, at most 255 bytes, and the sum of all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(B.blocks(_bytes("text"), 255)).alias("b"))
    docs = docs.select("doc_id", F.col("b.number").cast("long").alias("block"), B.figures(F.col("b.block")).alias("f"))
    return docs.select("doc_id", "block", F.col("f.n").alias("length"), ((1 + F.col("f.n") + F.col("f.total")) % 256).alias("checksum"))


@query(
    """SELECT p_partkey, list_reduce(list_prepend(CAST(len(p_name) AS BIGINT), list_transform(string_split(upper(p_name), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda h, c: (h * 13 + c) & 2047) % 72 AS slot FROM part"""
)
def directory_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", B.name_hash(F.col("p_name")).alias("slot"))


@query("SELECT p_brand, upper(p_name) AS folded, count(*) AS entries FROM part GROUP BY ALL HAVING count(*) > 1")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated_names(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query(
    """WITH asked AS (SELECT l_orderkey, l_linenumber, p_brand, lower(p_name) AS p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
folded AS (SELECT p_brand, upper(p_name) AS f, min(p_partkey) AS p_partkey FROM part GROUP BY ALL)
SELECT l_orderkey, l_linenumber, folded.p_partkey FROM asked LEFT JOIN folded ON asked.p_brand = folded.p_brand AND upper(asked.p_name) = f"""
)
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    asked = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_brand", F.lower("p_name").alias("p_name"))
    return audit.look_up(asked, part, "p_brand", "p_name").select("l_orderkey", "l_linenumber", "p_partkey")


@query("SELECT l_partkey AS block, count(DISTINCT l_orderkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def contested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.contested(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("block"), "l_orderkey"), ["block"], "l_orderkey")


_USED = "used AS (SELECT DISTINCT l_partkey AS block FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), bitmap AS (SELECT p_partkey AS block, p_size % 3 = 0 AS free FROM part)"


def _device(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("block"))
    return used, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block"), (F.col("p_size") % 3 == 0).alias("free"))


@query(f"WITH {_USED} SELECT block FROM used JOIN bitmap USING (block) WHERE free")
def used_but_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.used_but_free(*_device(spark, sf_dir), ["block"])


@query(f"WITH {_USED} SELECT block FROM bitmap WHERE NOT free AND block NOT IN (SELECT block FROM used)")
def allocated_but_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.allocated_but_unused(*_device(spark, sf_dir), ["block"])


@query(
    """WITH t AS (
    SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) AS b FROM lineitem
), j AS (SELECT x.l_orderkey, x.a, x.l_partkey <> y.l_partkey AS wrong FROM t x JOIN t y ON x.l_orderkey = y.l_orderkey AND x.a = y.b)
SELECT l_orderkey, count(*) AS n_blocks, min(CASE WHEN wrong THEN a - 1 END) AS first_wrong FROM j GROUP BY 1 HAVING bool_or(wrong)"""
)
def pointer_table_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.out_of_order(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")


@query(
    """SELECT o_orderkey, CAST(o_totalprice / 20000 AS BIGINT) AS declared, coalesce(n, 0) AS held,
    CASE WHEN coalesce(n, 0) < CAST(o_totalprice / 20000 AS BIGINT) THEN 'short' WHEN coalesce(n, 0) > CAST(o_totalprice / 20000 AS BIGINT) THEN 'long' ELSE 'none' END AS fault
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def declared_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves are rounded to even, as the SQL's cast does."""
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.rint(F.col("o_totalprice") / 20000).cast("long").alias("size"))
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).cast("long").alias("one"))
    return audit.size_faults(files, blocks, "o_orderkey", "size", "one")


@query(
    """WITH b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, place AS block, CASE WHEN l_orderkey % 5 <> 0 THEN n - place END AS steps, l_orderkey % 5 = 0 AS loops FROM b"""
)
def chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks linked by ship date; the last block of every fifth file points back to its first, and so loops."""
    w = Window.partitionBy("l_orderkey")
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w.orderBy("l_shipdate", "l_linenumber", "l_partkey")).cast("long").alias("block"), F.count("*").over(w).alias("n"))
    following = F.when(F.col("block") < F.col("n"), F.col("block") + 1).when(F.col("l_orderkey") % 5 == 0, 1)
    return chains.walk(blocks.select("l_orderkey", "block", following.alias("next")), ["l_orderkey"], "block", "next")


@query(
    """WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
n AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS stop FROM d)
SELECT l.l_orderkey, l_linenumber, l.l_partkey AS at, coalesce(stop, 1000000) - l.l_partkey AS length FROM lineitem l JOIN n ON n.l_orderkey = l.l_orderkey AND n.l_partkey = l.l_partkey"""
)
def payload_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("at"))
    out = sequences.next_boundary(entries, ["l_orderkey"], "at", F.lit(1_000_000), "stop")
    return out.select("l_orderkey", "l_linenumber", "at", (F.col("stop") - F.col("at")).alias("length"))


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS inputs_from FROM events"""
)
def repeated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an input recording: a frame of type view repeats the inputs of the last frame that had its own."""
    frames = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_id")).alias("inputs"))
    return sequences.repeat_last(frames, ["user_id"], ["ts", "event_id"], "inputs", "inputs_from").select("event_id", "user_id", "inputs_from")


@query(
    """SELECT event_id, CASE WHEN event_type <> 'click' AND coalesce(lag(event_type = 'click') OVER w, false) THEN lag(event_id) OVER w END AS header FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def headers_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sequences.carry_header(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_id"), "header").select("event_id", "header")


@query(
    """SELECT conv_id, turn, 2049 + coalesce(CAST(sum(octet_length(encode(coalesce(text, ''))) + 5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS address FROM conversations"""
)
def line_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of a stored program stand: each has a link, a number, its bytes and an end."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.octet_length(_bytes("text")) + 5).alias("size"))
    return sequences.running_start(lines, ["conv_id"], ["turn"], F.col("size"), "address", 2049).select("conv_id", "turn", F.col("address").cast("long").alias("address"))


_RUNS = """
marked AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS run FROM marked)
"""


@query(f"WITH {_RUNS} SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS length FROM numbered GROUP BY user_id, run")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_type FROM events")
def run_lengths_unrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.unrolled(run_lengths(spark, sf_dir), ["user_id"], "event_type")


_SCORES = "p_partkey, p_size % 11 - 5 AS a, p_partkey % 9 - 4 AS b, CAST(floor(p_retailprice) AS BIGINT) % 7 - 3 AS c"


@query(
    f"""WITH s AS (SELECT {_SCORES} FROM part), u AS (SELECT p_partkey, 32704 AS o, a AS score FROM s UNION ALL SELECT p_partkey, 65472, b FROM s UNION ALL SELECT p_partkey, 4259776, c FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, o) AS k FROM u WHERE score > 0)
SELECT s.p_partkey, CAST(r.o AS BIGINT) AS header_offset, CAST(r.score AS BIGINT) AS score FROM s LEFT JOIN r ON r.p_partkey = s.p_partkey AND k = 1"""
)
def best_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three places for a cartridge's header the one of the best score."""
    s = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 11 - 5).cast("long").alias("a"), (F.col("p_partkey") % 9 - 4).alias("b"), (F.floor("p_retailprice") % 7 - 3).alias("c"))
    chosen = choices.best({0x7FC0: F.col("a"), 0xFFC0: F.col("b"), 0x40FFC0: F.col("c")})
    return s.select("p_partkey", chosen.alias("h")).select("p_partkey", F.col("h.offset").alias("header_offset"), "h.score")


@query(
    """WITH g AS (SELECT *, row_number() OVER (ORDER BY tr, sp, si DESC) AS rank FROM (
    SELECT t, s, d, CASE WHEN t BETWEEN 80 AND 84 THEN t - 80 WHEN t < 80 THEN 5 + 79 - t ELSE t END AS tr, s AS sp, d AS si FROM range(1, 87) a(t), range(9, 13) b(s), range(1, 3) c(d))),
images AS (SELECT o_orderkey, (o_orderkey % 2 + 1) * (o_orderkey % 5 + 8) * (o_orderkey % 87 + 1) * 512 + o_orderkey % 3 AS size FROM orders),
f AS (SELECT t * s * d * 512 AS size, arg_min(t, rank) AS tracks, arg_min(d, rank) AS sides, arg_min(s, rank) AS sectors_per_track FROM g GROUP BY 1)
SELECT o_orderkey, tracks, sides, sectors_per_track FROM images LEFT JOIN f ON f.size = images.size - images.size % 512"""
)
def disk_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    images = table(spark, sf_dir, "orders").select("o_orderkey", ((k % 2 + 1) * (k % 5 + 8) * (k % 87 + 1) * 512 + k % 3).alias("size"))
    return choices.fit_geometry(images, "size").select("o_orderkey", "geometry.*")


@query(
    """SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS even, b.l_partkey AS odd FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linenumber % 2 = 1"""
)
def interleaved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.pairs(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey")


@query(
    f"""WITH {_pieces(12288)}, screens AS (SELECT doc_id, s AS screen, rpad(x, 12288, '0') AS x FROM sectors)
SELECT doc_id, screen, md5(array_to_string(list_transform(range(192), lambda y: substring(x, CAST(2 * (((y & 192) << 5) | ((y & 7) << 8) | ((y & 56) << 2)) + 1 AS BIGINT), 64)), '')) AS rows_md5 FROM screens"""
)
def screen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as screens of 6144 bytes, their rows put from top to bottom."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _bytes("text").alias("bytes"))
    rest = F.pmod(-F.octet_length("bytes"), F.lit(rasters.SCREEN)).cast("int")
    docs = docs.select("doc_id", F.concat("bytes", F.unhex(F.repeat(F.lit("00"), rest))).alias("bytes"))
    docs = docs.select("doc_id", F.explode(B.blocks(F.col("bytes"), rasters.SCREEN)).alias("s"))
    return docs.select("doc_id", F.col("s.number").cast("long").alias("screen"), F.md5(rasters.linear(F.col("s.block"))).alias("rows_md5"))


@query(
    """SELECT l_orderkey, x, CAST(sum((1 << (l_linenumber - 1)) * ((CAST(l_quantity AS BIGINT) >> (7 - x)) & 1)) AS BIGINT) AS color FROM lineitem, range(8) t(x) GROUP BY ALL"""
)
def plane_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("plane"), F.col("l_quantity").cast("int").alias("byte"))
    return rasters.pixels(planes, ["l_orderkey"], "plane", "byte").select("l_orderkey", F.col("x").cast("long").alias("x"), F.col("color").cast("long").alias("color"))


@query(
    """SELECT p_brand, bit_or(1 << (p_size % 32)) AS bitmap, bit_count(bit_or(1 << (p_size % 32))) AS taken FROM (SELECT p_brand, CAST(p_size AS BIGINT) AS p_size FROM part) GROUP BY p_brand"""
)
def bitmap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", F.expr("shiftleft(1L, cast(p_size % 32 as int))").alias("bit"))
    return part.groupBy("p_brand").agg(F.bit_or("bit").alias("bitmap")).withColumn("taken", F.bit_count("bitmap").cast("long"))


@query(
    """SELECT r_name, n_name, count(*) AS disks, count(*) FILTER (c_acctbal < 0) AS faulty FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL"""
)
def machines_of_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    disks = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return disks.groupBy("r_name", "n_name").agg(F.count("*").alias("disks"), F.count_if(F.col("c_acctbal") < 0).alias("faulty"))


@query(
    """SELECT conv_id, turn, ord(role) AS kind, octet_length(encode(coalesce(text, ''))) AS length, md5(coalesce(text, '')) AS payload_md5 FROM conversations"""
)
def chunk_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as chunks of one stream for each conversation, and read back from its bytes."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.ascii("role").alias("kind"), _bytes("text").alias("payload"))
    files = streams.assemble(turns, ["conv_id"], "turn", "kind", "payload", streams.TAGGED)
    found = streams.split(files, ["conv_id"], "content", streams.TAGGED)
    first = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    found = found.join(first, "conv_id").withColumn("turn", F.get(F.col("turns"), F.col("ordinal")))
    return found.select("conv_id", "turn", F.col("kind").cast("long").alias("kind"), F.octet_length("payload").cast("long").alias("length"), F.md5("payload").alias("payload_md5"))


_FILES = "f AS (SELECT conv_id, 'TURN ' || turn AS name, encode(coalesce(text, '')) AS data, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS entry FROM conversations)"
_DISK_BLOCKS = "greatest(1, (octet_length(data) + 253) // 254)"


def _disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("TURN "), F.col("turn")).alias("name"), _bytes("text").alias("data"))
    return disks.volumes(turns, "conv_id", "turn", "name", "data")


@query(f"WITH {_FILES} SELECT conv_id, entry, name, 130 AS kind, {_DISK_BLOCKS} AS blocks FROM f")
def disk_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations mastered as disks, as many as each needs, a file for each turn, and their directories read back."""
    entries = disks.files_on(disks.directory(_disks(spark, sf_dir), "disk", "image"))
    entries = entries.groupBy(F.col("key").alias("conv_id"), F.col("file").alias("entry"))
    return entries.agg(F.first("name").alias("name"), F.first("kind").alias("kind"), F.sum("blocks").alias("blocks"))


@query(f"WITH {_FILES} SELECT conv_id, entry, {_DISK_BLOCKS} AS n_blocks, md5(data) AS data_md5 FROM f")
def disk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = disks.files_on(disks.contents(_disks(spark, sf_dir), "disk", "image")).groupBy(F.col("key").alias("conv_id"), F.col("file").alias("entry"))
    files = pieces.agg(F.sum("n_blocks").alias("n_blocks"), F.sort_array(F.collect_list(F.struct("piece", F.hex("data").alias("hex")))).alias("pieces"))
    return files.select("conv_id", "entry", "n_blocks", F.md5(F.unhex(F.array_join("pieces.hex", ""))).alias("data_md5"))


@query(f"WITH {_FILES} SELECT conv_id, 664 - CAST(sum({_DISK_BLOCKS}) AS BIGINT) AS free FROM f GROUP BY conv_id")
def disk_free_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = disks.free_blocks(_disks(spark, sf_dir), "disk", "image").groupBy(F.col("disk.key").alias("conv_id"))
    return free.agg((disks.CAPACITY - F.sum(disks.CAPACITY - F.col("free"))).alias("free"))


@query("SELECT doc_id, codec, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS decoded_md5 FROM documents, (VALUES ('deflate'), ('gzip'), ('raw'), ('bits'), ('track'), ('memory')) AS c(codec)")
def codec_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through every codec and back, in one pass over the texts. A text's own length bounds what is decoded."""
    raw = F.col("raw")
    docs = table(spark, sf_dir, "documents").select("doc_id", _bytes("text").alias("raw"))
    ways = {"deflate": ("deflate", {}), "gzip": ("deflate", {"wrapping": "gzip"}), "raw": ("deflate", {"wrapping": "raw"}), "bits": ("bits", {}), "track": ("track", {}), "memory": ("memory", {})}
    each = [F.struct(F.lit(name).alias("codec"), codecs.decode(codecs.encode(raw, codec, **o), codec, F.octet_length(raw), **o)["value"].alias("value")) for name, (codec, o) in ways.items()]
    out = docs.select("doc_id", F.explode(F.array(*each)).alias("d"))
    return out.select("doc_id", "d.codec", F.octet_length("d.value").cast("long").alias("n_bytes"), F.md5("d.value").alias("decoded_md5"))


@query(
    """SELECT p_partkey, 'crt' AS format, CAST(64 AS BIGINT) AS header_length, CAST(p_size AS BIGINT) AS hardware, p_partkey % 2 AS exrom, rtrim(substring(p_name, 1, 32)) AS name FROM part"""
)
def cartridge_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as cartridge headers, recognised by their first bytes and read back."""
    c = F.col
    values = {"header_length": F.lit(64), "version": F.lit(0x100), "hardware": c("p_size"), "exrom": c("p_partkey") % 2, "name": F.substring("p_name", 1, 32)}
    files = table(spark, sf_dir, "part").select("p_partkey", headers.header(values, "crt").alias("content"))
    f = headers.fields(c("content"), "crt")
    return files.select("p_partkey", headers.sniffed(c("content")).alias("format"), f.alias("f")).select("p_partkey", "format", "f.header_length", "f.hardware", "f.exrom", "f.name")


@query(
    f"""WITH {_pieces(2048)},
patterns AS (SELECT doc_id, s, unnest(list_transform(range(256), lambda i: {{'i': i, 'w': CAST('0x' || substring(rpad(x, 2048, '0'), CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)}})) AS c FROM sectors)
SELECT doc_id, c.i % 4 AS channel, count(*) AS cells, CAST(sum(((c.w >> 28) & 15) * 16 + ((c.w >> 12) & 15)) AS BIGINT) AS samples, CAST(sum((c.w >> 16) & 4095) AS BIGINT) AS periods,
    CAST(sum((c.w >> 8) & 15) AS BIGINT) AS effects, max(c.w & 255) AS parameter, CAST(sum((c.i // 4) * (c.w & 1)) AS BIGINT) AS odd_rows
FROM patterns GROUP BY doc_id, c.i % 4"""
)
def tracker_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as patterns of a tracker module, their notes summed up by channel."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(B.blocks(_bytes("text"), 1024)).alias("p"))
    docs = docs.select("doc_id", F.col("p.number").alias("pattern"), F.unhex(F.rpad(F.hex("p.block"), 2048, "0")).alias("raw"))
    notes = layouts.notes(docs, ["doc_id", "pattern"], "raw").groupBy("doc_id", "channel")
    odd = F.sum(F.col("row") * F.col("parameter").bitwiseAND(1))
    return notes.agg(F.count("*").alias("cells"), F.sum("sample").alias("samples"), F.sum("period").alias("periods"), F.sum("effect").alias("effects"), F.max("parameter").alias("parameter"), odd.alias("odd_rows"))


@query(
    """SELECT l_orderkey, l_linenumber, b & 7 AS ink, (b >> 3) & 7 AS paper, (b >> 6) & 1 AS bright, (b >> 7) & 1 AS flash FROM (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS b FROM lineitem)"""
)
def cell_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layouts.attribute(F.col("l_partkey") % 256).alias("a"))
    return cells.select("l_orderkey", "l_linenumber", "a.*")


@query(
    """WITH t AS (SELECT t AS track, CASE WHEN t <= 17 THEN 21 WHEN t <= 24 THEN 19 WHEN t <= 30 THEN 18 ELSE 17 END AS n FROM range(1, 36) r(t)),
f AS (SELECT track, n, CAST(sum(n) OVER (ORDER BY track) AS BIGINT) - n AS first FROM t)
SELECT p_partkey, track, p_partkey % 700 - first AS sector FROM part LEFT JOIN f ON p_partkey % 700 >= first AND p_partkey % 700 < first + n"""
)
def block_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "part").select("p_partkey", layouts.address(F.col("p_partkey") % 700, disks.SECTORS).alias("a"))
    return blocks.select("p_partkey", "a.track", "a.sector")


@query(
    """WITH c AS (SELECT o_custkey, o_orderstatus AS r, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS files, array_to_string(list_sort(list_filter(['F', 'O', 'P'], lambda x: NOT list_contains(list(r), x))), ',') AS missing,
    coalesce(array_to_string(list_sort(list(r) FILTER (n > 1)), ','), '') AS repeated FROM c GROUP BY o_custkey"""
)
def file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as the files of a set, their states as roles of which a set needs each once."""
    return layouts.sets(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query(
    """SELECT event_id, coalesce(CAST(sum(8 * CAST(floor(abs(value)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS cycle FROM events"""
)
def pulse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each pulse of a tape starts, in cycles; a pulse is stored as an eighth of its cycles."""
    pulses = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (8 * F.floor(F.abs("value"))).alias("cycles"))
    return sequences.running_start(pulses, ["user_id"], ["ts", "event_id"], F.col("cycles"), "cycle").select("event_id", F.col("cycle").cast("long").alias("cycle"))


#: The parts of a line as the tokeniser takes them, and what is listed for each: quoted text, and all after REM, keep
#: their bytes up to 255, ? is PRINT outside them, and a character without a byte is a question mark.
_PARTS = r"""\"[^\"]*\"?|REM[\s\S]*|DATA(?:[^:\"]|\"[^\"]*\"?)*|""" + "|".join(re.escape(k).replace("'", "''") for k in sorted(basic.KEYWORDS, key=len, reverse=True)) + r"|\?|[\s\S]"
_LISTED = rf"""WITH parts AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{_PARTS}') AS p FROM conversations)
SELECT conv_id, turn, md5(array_to_string(list_transform(p, lambda x:
    CASE WHEN x = '?' THEN 'PRINT' WHEN x[1] = '"' OR starts_with(x, 'REM') THEN regexp_replace(x, '[^\x00-\x{{FF}}]', '?', 'g')
    WHEN starts_with(x, 'DATA') THEN array_to_string(list_transform(regexp_extract_all(x, '\"[^\"]*\"?|[^\"]+'), lambda y: CASE WHEN y[1] = '"' THEN regexp_replace(y, '[^\x00-\x{{FF}}]', '?', 'g') ELSE regexp_replace(y, '[^\x00-\x7F]', '?', 'g') END), '')
    ELSE regexp_replace(x, '[^\x00-\x7F]', '?', 'g') END), '')) AS listed_md5 FROM parts"""


@query(_LISTED)
def program_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a line of a program, stored and listed again: ? as PRINT, characters without a byte as question marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    lines = basic.stored(turns, ["conv_id"], "turn", "text")
    body = F.expr("substring(line, 5, octet_length(line) - 5)")
    return lines.select("conv_id", "turn", F.md5(basic.listed_of(body)).alias("listed_md5"))


def _header_values() -> tuple[list[tuple[str, str, str, int]], str]:
    """(format, field, kind, size) of every field of every header, and SQL rows of them."""
    each = [(kind, f.name, f.kind, f.size) for kind, fields in headers.FORMATS.items() for f in fields if (kind, f.name) != ("mod", "magic")]
    return each, ", ".join(f"('{k}', '{n}', '{t}', {size})" for k, n, t, size in each)


@query(
    f"""SELECT p_partkey, format, field, CASE WHEN kind = 's' THEN rtrim(substring(p_name, 1, size)) ELSE CAST((p_partkey * 7 + 3) % (CAST(1 AS BIGINT) << (8 * size)) AS VARCHAR) END AS value
FROM part, (VALUES {_header_values()[1]}) AS f(format, field, kind, size)"""
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as headers of all formats and read back, a row for each field.

    Each format is a branch of its own: all in one row make a generated method too long for the JVM to compile (8000 bytes)."""
    parts, out = table(spark, sf_dir, "part").select("p_partkey", "p_name"), None
    for kind, fields in headers.FORMATS.items():
        values = {f.name: F.substring("p_name", 1, f.size) if f.kind == "s" else (F.col("p_partkey") * 7 + 3) % (1 << 8 * f.size) for f in fields if (kind, f.name) != ("mod", "magic")}
        files = parts.select("p_partkey", F.concat(headers.header(values, kind), F.lit(bytes(8))).alias("content"))
        found = files.select("p_partkey", headers.fields(F.col("content"), kind).alias("f"))
        each = F.array(*(F.struct(F.lit(kind).alias("format"), F.lit(n).alias("field"), F.col("f")[n].cast("string").alias("value")) for n in values))
        rows = found.select("p_partkey", F.explode(each).alias("h")).select("p_partkey", "h.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    """SELECT layout, conv_id, turn, CASE WHEN layout <> 'tap' THEN ord(role) END AS kind, octet_length(encode(coalesce(text, ''))) AS length, md5(coalesce(text, '')) AS payload_md5
FROM conversations, (VALUES ('uef'), ('iff'), ('szx'), ('tap'), ('rzx')) AS l(layout)"""
)
def chunk_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as chunks of one stream for each conversation in every layout, and read back. Chunks are numbered as turns are in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.ascii("role").alias("kind"), _bytes("text").alias("payload"))
    numbered = turns.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("ordinal"))
    out = None
    for name, layout in streams.LAYOUTS.items():
        found = streams.split(streams.assemble(turns, ["conv_id"], "turn", "kind", "payload", layout), ["conv_id"], "content", layout)
        found = found.select(F.lit(name).alias("layout"), "conv_id", "ordinal", F.col("kind").cast("long").alias("kind"), F.octet_length("payload").cast("long").alias("length"), F.md5("payload").alias("payload_md5"))
        out = found if out is None else out.unionByName(found)
    return out.join(numbered, ["conv_id", "ordinal"]).drop("ordinal")


@query(
    f"""WITH {_pieces(510)},
b AS (SELECT doc_id, s, (1 + len(x) // 2 + list_sum(list_transform(regexp_extract_all(x, '..'), lambda y: CAST('0x' || y AS BIGINT)))) % 256 AS computed FROM sectors),
c AS (SELECT *, (computed + CASE WHEN doc_id % 3 = 0 AND s % 4 = 3 THEN 1 ELSE 0 END) % 256 = computed AS valid FROM b)
SELECT doc_id, count(*) AS n_blocks, bool_and(valid) AS valid, min(CASE WHEN NOT valid THEN s END) AS first_bad FROM c GROUP BY doc_id"""
)
def checked_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapes whose blocks carry a checksum, every fourth one of every third tape spoilt: whether all hold."""
    blocks = tape_blocks(spark, sf_dir)
    spoilt = ((F.col("doc_id") % 3 == 0) & (F.col("block") % 4 == 3)).cast("long")
    stored = blocks.withColumn("stored", (F.col("checksum") + spoilt) % 256)
    return audit.verdicts(stored, "doc_id", "block", F.col("stored") == F.col("checksum"))


@query(
    """WITH h AS (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS h FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.h AS x, b.h AS y, greatest(len(a.h), len(b.h)) // 2 AS n FROM h a JOIN h b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 1)
SELECT conv_id, turn, 2 * n AS n_bytes, md5(array_to_string(list_transform(range(n), lambda i: rpad(substring(x, 2 * i + 1, 2), 2, '0') || rpad(substring(y, 2 * i + 1, 2), 2, '0')), '')) AS hex_md5 FROM p"""
)
def interleaved_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as chips of a cartridge: the bytes of each pair in turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", _bytes("text").alias("rom"))
    merged = choices.pairs(turns, ["conv_id"], "turn", "rom").select("conv_id", "turn", B.interleaved("even", "odd").alias("rom"))
    return merged.select("conv_id", "turn", F.octet_length("rom").cast("long").alias("n_bytes"), F.md5(F.hex("rom").cast("binary")).alias("hex_md5"))


_PLAUSIBLE = "bs = 512 AND si BETWEEN 1 AND 2 AND sp BETWEEN 8 AND 12 AND tot > 0 AND tot % (si * sp) = 0 AND tot // (si * sp) BETWEEN 1 AND 86"


@query(
    f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY tr, sp, si DESC) AS rank FROM (
    SELECT t, s, d, CASE WHEN t BETWEEN 80 AND 84 THEN t - 80 WHEN t < 80 THEN 5 + 79 - t ELSE t END AS tr, s AS sp, d AS si FROM range(1, 87) a(t), range(9, 13) b(s), range(1, 3) c(d))),
f AS (SELECT t * s * d * 512 AS fsize, arg_min(t, rank) AS ft, arg_min(d, rank) AS fd, arg_min(s, rank) AS fs FROM g GROUP BY 1),
i AS (SELECT o_orderkey, (o_orderkey % 2 + 1) * (o_orderkey % 5 + 8) * (o_orderkey % 87 + 1) * 512 + o_orderkey % 3 AS size, CASE WHEN o_orderkey % 11 = 0 THEN 256 ELSE 512 END AS bs,
    o_custkey % 3 AS si, o_custkey % 6 + 7 AS sp, (o_custkey % 3) * (o_custkey % 6 + 7) * (o_orderkey % 90) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS tot FROM orders),
b AS (SELECT *, CASE WHEN {_PLAUSIBLE} THEN tot // (si * sp) END AS bt FROM i LEFT JOIN f ON fsize = size - size % 512),
c AS (SELECT *, CASE WHEN bt * si * sp * 512 = size - size % 512 THEN 'boot' WHEN ft IS NOT NULL THEN 'size' WHEN bt * si * sp * 512 <= size THEN 'boot' END AS way FROM b)
SELECT o_orderkey, CASE way WHEN 'boot' THEN bt WHEN 'size' THEN ft END AS tracks, CASE way WHEN 'boot' THEN si WHEN 'size' THEN fd END AS sides, CASE way WHEN 'boot' THEN sp WHEN 'size' THEN fs END AS sectors_per_track FROM c"""
)
def boot_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as disk images whose boot sectors declare a geometry, some of them wrongly."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sides, per_track = c % 3, c % 6 + 7
    total = sides * per_track * (k % 90) + (k % 7 == 0).cast("long")
    parts = [F.lit(bytes(0x0B)), B.packed(F.when(k % 11 == 0, 256).otherwise(512), 2), F.lit(bytes(6)), B.packed(total, 2), F.lit(bytes(3)), B.packed(per_track, 2), B.packed(sides, 2), F.lit(bytes(512 - 28))]
    images = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(*parts).alias("boot"), ((k % 2 + 1) * (k % 5 + 8) * (k % 87 + 1) * 512 + k % 3).alias("size"))
    return choices.geometry_of(images, "boot", "size").select("o_orderkey", "geometry.*")


@query(
    """WITH asked AS (SELECT l_orderkey, l_linenumber, p_brand, lower(p_name) AS p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
folded AS (SELECT p_brand, upper(p_name) AS f, min({'a': p_size, 'b': p_retailprice, 'c': p_partkey}) AS e FROM part GROUP BY ALL)
SELECT l_orderkey, l_linenumber, e.a AS p_size, e.c AS p_partkey FROM asked LEFT JOIN folded ON asked.p_brand = folded.p_brand AND upper(asked.p_name) = f"""
)
def entry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the whole first entry of their name."""
    part = table(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_partkey", "p_brand", "p_name")
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand", F.lower("p_name").alias("p_name"))
    asked = table(spark, sf_dir, "lineitem").join(names, F.col("k") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "p_name")
    return audit.look_up(asked, part, "p_brand", "p_name").select("l_orderkey", "l_linenumber", "p_size", "p_partkey")


#: The same rows under the name that they had in the first version.
QUERIES["program_listings_all"], ORACLES["program_listings_all"] = program_listings, _LISTED
