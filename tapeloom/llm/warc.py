"""Legacy archive converter: ARC records become WARC records.

An ARC file starts with a version block, whose second line says which fields the header lines have; each record is a
header line and as many bytes as it declares. Version 1 has URL, address, date, type and length; version 2 has five
more in front of the length. The fields are counted from the right, so an URL may hold spaces. A record becomes a
WARC response with a made identifier (from its archive, place, address and date), an ISO timestamp, block and payload
digests (SHA-256, hexadecimal). A record whose payload repeats that of an earlier page becomes a revisit, which keeps the
HTTP header and the digest and refers to the record that holds the payload.

Three steps, each a table: `archive` stores pages as ARC files of both versions, `convert` reads ARC files as rows and
writes WARC archives, `read` gives a row for each WARC record. An archive of either kind is a row of a Parquet table, so
any store can hold it; WARC records are single gzip members, so an archive's bytes are a .warc.gz file.

Defined cases: a null html is an empty payload; a null url is `about:blank`, and line ends in it are escaped. A record
without a page number is a response. Repeated rows of the smallest id are all responses, with identifiers of their own.
A malformed or cut-off ARC file yields its records up to there and a row with a fault (`faults`), which isn't converted.
A very long page is a record like any other, held in one row of at most 2 GB. An empty table writes no archive. Other
columns aren't read, so their names may be any.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, written

ARCHIVE_BYTES = 4 << 20
#: An ARC file holds pages of about so many bytes.
ARC_BYTES = 1 << 20
#: Payloads below it are never revisits.
MIN_REVISIT_BYTES = 100
#: Up to so many rows of 100 bytes are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Up to so many archives' lists of revisits, at most about a hundred kilobytes each, are broadcast.
BROADCAST_ARCHIVES = 200

#: Fixed by the formats: fields of a header line and of a WARC record.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = b"X-Page-Id: "
#: This engine's own field: the number of the page that a revisit refers to.
REFERS_TO_PAGE = "WARC-Refers-To-Page"
_START = datetime(1996, 9, 23, tzinfo=UTC)


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    at: int = 0

    @property
    def payload_at(self) -> int:
        """Where the payload starts: after the HTTP header, if the block has one."""
        at = self.block.find(b"\r\n\r\n")
        return at + 4 if self.block.startswith(b"HTTP/") and at >= 0 else 0

    @property
    def date(self) -> str:
        return datetime.strptime(self.fields["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")

    def identifier(self, archive: str) -> str:
        """A record's name, made of its archive, place, address and date."""
        named = f"{archive} {self.at} {self.fields['URL']} {self.date}".encode("utf-8", "replace")
        return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(named).digest()[:16], version=5)}>"


def build_arc(version: int, name: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, date, type, block) records."""
    about = f"{version} 0 tapeloom\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    out = [f"filedesc://{name} 0.0.0.0 19960923000000 text/plain{extra} {len(about)}\n".encode(), about]
    for url, date, kind, block in records:
        url = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
        out += [b"\n", f"{url} 0.0.0.0 {date} {kind}{extra} {len(block)}\n".encode("utf-8", "replace"), block]
    return b"".join(out)


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block; the version says how the header lines are read."""

    def header(at: int, names: tuple[str, ...]) -> tuple[dict[str, str], int]:
        end = raw.index(b"\n", at)
        parts = raw[at:end].decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"ARC header line at {at} has {len(parts)} fields")
        return dict(zip(names, parts, strict=True)), end + 1

    length, at = int(raw[: raw.index(b"\n")].rsplit(b" ", 1)[1]), raw.index(b"\n") + 1
    version = int(raw[at : raw.index(b" ", at)])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version}")
    names = tuple(raw[at : at + length].split(b"\n")[1].decode().split(" "))
    at += length
    while at < len(raw):
        while raw[at : at + 1] == b"\n":
            at += 1
        if at >= len(raw):
            return
        fields, at = header(at, names)
        size = int(fields["Archive-length"])
        if at + size > len(raw):
            raise ValueError(f"ARC record at {at} is cut off")
        yield ArcRecord(fields, raw[at : at + size], at)
        at += size


def to_warc(record: ArcRecord, archive: str, digest: str, refers_to: dict | None) -> bytes:
    """The WARC record of an ARC record; refers_to has page, record, date and url of the record with the same payload."""
    block = record.block if refers_to is None else record.block[: record.payload_at]
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record.identifier(archive)}", f"WARC-Date: {record.date}", f"WARC-Target-URI: {record.fields['URL']}"]
    if record.fields["IP-address"] != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {record.fields['IP-address']}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to['record']}", f"WARC-Refers-To-Target-URI: {refers_to['url']}", f"WARC-Refers-To-Date: {refers_to['date']}", f"{REFERS_TO_PAGE}: {refers_to['page']}"]
    kind = "application/http; msgtype=response" if record.payload_at else record.fields["Content-type"]
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive of gzip members."""
    rest = raw
    while rest:
        member = zlib.decompressobj(31)
        plain = member.decompress(rest) + member.flush()
        rest = member.unused_data
        head, _, body = plain.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, body[: int(fields["Content-Length"])]


def _http(page: int | None, payload: bytes) -> bytes:
    lines = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    if page is not None:
        lines.append(PAGE + b"%d" % page)
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload


def _fields(http: bytes) -> dict[bytes, bytes]:
    return {name: value for name, _, value in (x.partition(b": ") for x in http.split(b"\r\n\r\n", 1)[0].split(b"\r\n")[1:])}


def _page(block: bytes) -> int | None:
    page = _fields(block).get(PAGE.rstrip(b": ")) if block.startswith(b"HTTP/") else None
    return int(page) if page is not None else None


def _arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ARC files of about ARC_BYTES of a task's pages, of each version in turn by the page's number."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {version: [] for version in ARC_FIELDS}
    size = dict.fromkeys(ARC_FIELDS, 0)

    def closed(version: int) -> pa.RecordBatch:
        nonlocal number
        name = f"part-{part}-{number}.arc"
        number += 1
        out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([build_arc(version, name, held[version])], pa.binary())], ["name", "arc"])
        held[version], size[version] = [], 0
        return out

    for batch in batches:
        for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            version = (page or 0) % 2 + 1
            date = (_START + timedelta(seconds=(page or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
            held[version].append((url, date, "text/html", _http(page, html or b"")))
            size[version] += len(html or b"")
            if size[version] >= ARC_BYTES:
                yield closed(version)
    for version in ARC_FIELDS:
        if held[version]:
            yield closed(version)


def archive(pages: DataFrame, to: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as a table (name, arc) of legacy archives."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("binary").alias("html"))
    rows.mapInArrow(_arcs, "name string, arc binary").write.parquet(to)


def _records(name: str, raw: bytes) -> Iterator[ArcRecord | str]:
    """The records of an archive, and what is wrong with it if it is."""
    try:
        for record in parse_arc(raw):
            record.date  # noqa: B018  a date that can't be read is a fault too
            yield record
    except ValueError as e:
        yield str(e)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for record in _records(name, raw.as_py() or b""):
                if isinstance(record, str):
                    rows.append((name, None, None, None, None, None, None, record))
                else:
                    payload = record.block[record.payload_at :]
                    rows.append((name, _page(record.block), hashlib.sha256(payload).hexdigest(), len(payload), record.identifier(name), record.date, record.fields["URL"], None))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "page", "digest", "size", "record", "date", "url", "fault"])


def payloads(archives: DataFrame) -> DataFrame:
    """(name, page, digest, size, record, date, url, fault) of each record of legacy archives (name, arc)."""
    bounded_batches(archives.sparkSession)
    schema = "name string, page long, digest string, size long, record string, date string, url string, fault string"
    return archives.select(F.col("name").cast("string"), F.col("arc").cast("binary")).mapInArrow(_digests, schema)


def faults(archives: DataFrame) -> DataFrame:
    """(name, fault) of archives that can't be read to their end."""
    return payloads(archives).filter("fault is not null").select("name", "fault")


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for name, raw, revisits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            known = {r["record"]: r["refers_to"] for r in revisits or ()}
            for record in _records(name, raw.as_py() or b""):
                if isinstance(record, str):
                    break
                digest = hashlib.sha256(record.block[record.payload_at :]).hexdigest()
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                held.append(deflate.compress(to_warc(record, name, digest, known.get(record.identifier(name)))) + deflate.flush())
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["records", "archive"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["records", "archive"])


def convert(archives: DataFrame, to: str) -> None:
    """Write the records of legacy archives (name, arc), each name once, as a table of WARC archives.

    Payloads meet by digest: each task reduces its records to the first of a digest, so a payload that very many pages
    share is no more work than any other, and only identifiers and digests are joined. An archive's revisits, at most its
    records, are joined to it as a list."""
    spark = archives.sparkSession
    archives = archives.select(F.col("name").cast("string"), F.col("arc").cast("binary"))
    seen = written(payloads(archives).filter(f"size >= {MIN_REVISIT_BYTES} and page is not null").drop("fault", "size"), "payloads")
    target = F.struct("page", "record", "date", "url")
    first = seen.groupBy("digest").agg(F.min(target).alias("refers_to"), F.max("page").alias("last")).filter("last > refers_to.page").select("digest", "refers_to")
    first = written(first, "first")
    small = first.count() <= BROADCAST_ROWS
    again = seen.join(F.broadcast(first) if small else first, "digest").filter("page > refers_to.page")
    again = written(again.groupBy("name").agg(F.collect_list(F.struct("record", "refers_to")).alias("revisits")), "revisits")
    small = again.count() <= BROADCAST_ARCHIVES
    bounded_batches(spark)
    marked = archives.join(F.broadcast(again) if small else again, "name", "left").select("name", "arc", "revisits")
    marked.mapInArrow(_converted, "records long, archive binary").write.parquet(to)


def read(spark: SparkSession, at: str, key: str = "page_id") -> DataFrame:
    """A row for each record of a table of archives."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                out: list[list] = [[] for _ in range(8)]
                for fields, block in parse_warc(raw.as_py()):
                    refers_to, response = fields.get(REFERS_TO_PAGE), fields["WARC-Type"] == "response"
                    http = block.startswith(b"HTTP/")
                    payload = block[block.find(b"\r\n\r\n") + 4 :] if http else block
                    declared = _fields(block).get(b"Content-Length") if http else None
                    size = int(declared) if declared is not None else len(payload) if response else None
                    row = (_page(block), size, fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], None if refers_to is None else int(refers_to), fields["WARC-Record-ID"], fields["WARC-Date"], fields["WARC-Target-URI"])
                    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != row[2]):
                        raise ValueError(f"payload of {row[5]} differs from its header")
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "target_uri"])

    schema = "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, target_uri string"
    return spark.read.parquet(at).select("archive").mapInArrow(run, schema).withColumnRenamed("page", key)
