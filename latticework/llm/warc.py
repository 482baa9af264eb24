"""Web archives: reading legacy ARC files, converting them to WARC, writing and reading WARC.

ARC: a file starts with a version block (a ``filedesc://`` header line, then its declared number of bytes, whose
first line names the version). Version 1 header lines have five fields, version 2 lines ten; a record's body is the
declared number of bytes after its header line. The converter reads both and makes the equivalent WARC fields: a
record id (a name-based UUID over archive, offset and header line, so a repeated conversion gives the same
id), the date in ISO form, a type (``warcinfo`` for version blocks, ``response`` for HTTP bodies, ``resource`` for others), and
the SHA-1 digests of block and payload.

Identical payloads: of response records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the
largest row id stays a response, and the others become revisit records that refer to it. The winners of a digest come
from a partial aggregate; the join back reads two written tables, so Spark splits a digest that holds many rows.

Files: Spark's text writer with the WARC record separator as line separator, so records are written by tasks
under Spark's commit protocol to any store, one gzip stream for each file.

Defined results: null html is an empty payload (SHA-1 of no bytes); payloads under the bound are always responses;
rows that repeat an id are told apart by record id, and the revisit names the shared id; a null id loses to
any other; a null url is written as ``about:blank``; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 20_000
FILE_BYTES = 256 << 20  # of payloads in an archive file, on average
FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
SPEC = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes
    offset: int


def iso_date(stamp: str) -> str:
    """ARC's 14 digits (12 or 8 in old files) as a WARC date."""
    digits = stamp[:14].ljust(8, "0")
    digits = digits[:8] + digits[8:].ljust(6, "0")
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """All records of an uncompressed ARC file, the version block first."""
    at, version = 0, 0
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):  # separators between records
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} is not ended")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if parts[0].startswith("filedesc://"):
            length = int(parts[-1])
            body = data[end + 1 : end + 1 + length]
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            names = FIELDS[2 if len(parts) == len(FIELDS[2]) else 1]
        else:
            if not version:
                raise ValueError("no version block")
            names = FIELDS[version]
            if len(parts) != len(names):
                raise ValueError(f"header line at {at} has {len(parts)} fields, version {version} has {len(names)}")
            length = int(parts[-1])
            body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"record at {at} declares {length} bytes and has {len(body)}")
        yield ArcRecord(version, dict(zip(names, parts)), body, at)
        at = end + 1 + length


def write_arc(version: int, name: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, 14-digit date, mime, body)."""

    def line(url, ip, date, mime, offset, body):
        if version == 1:
            return f"{url} {ip} {date} {mime} {len(body)}\n".encode()
        check = zlib.crc32(body)
        return f"{url} {ip} {date} {mime} 200 {check:08x} - {offset} {name} {len(body)}\n".encode()

    about = f"{version} 0 latticework\n{SPEC[version]}\n\n".encode()
    out = bytearray(line(f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", 0, about) + about + b"\n")
    for url, date, mime, body in records:
        out += line(url, "0.0.0.0", date, mime, len(out), body) + body + b"\n"
    return bytes(out)


def split_http(body: bytes) -> tuple[bytes, bytes] | None:
    """Head (with its blank line) and payload of an HTTP message, or None."""
    if not body.startswith(b"HTTP/"):
        return None
    for gap in (b"\r\n\r\n", b"\n\n"):
        if (k := body.find(gap)) >= 0:
            return body[: k + len(gap)], body[k + len(gap) :]
    return body, b""


def to_warc(record: ArcRecord, archive: str) -> dict:
    """The WARC fields equivalent to an ARC record."""
    f = record.fields
    http = split_http(record.body)
    about = f["url"].startswith("filedesc://")
    kind = "warcinfo" if about else "response" if http else "resource"
    head, payload = http if http else (b"", record.body)
    line = " ".join(f.values())
    return {
        "record_id": f"urn:uuid:{uuid.uuid5(_SPACE, f'{archive}#{record.offset}#{line}')}",
        "date": iso_date(f["date"]),
        "type": kind,
        "uri": f["url"],
        "mime": "application/warc-fields" if about else "application/http; msgtype=response" if http else f["mime"],
        "head": head,
        "payload": payload,
        "block_sha1": hashlib.sha1(record.body).hexdigest(),
        "payload_sha1": hashlib.sha1(payload).hexdigest(),
    }


def arc_date(n: int | None) -> str:
    """A stamp for a page of a table without dates: so many seconds after the start of 1996."""
    return (datetime(1996, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=abs(n or 0) % (1 << 33))).strftime("%Y%m%d%H%M%S")


_ROW = "row_id long, record_id string, date string, uri string, head binary, payload binary, payload_bytes long, payload_sha1 string, block_sha1 string"
_URL_UNSAFE = {c: f"%{c:02X}" for c in range(33)} | {127: "%7F"}


def _convert(batches):
    """Each batch of pages becomes one legacy archive of either version, which the converter then reads."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for b in batches:
        ids, urls, pages = (b.column(k).to_pylist() for k in range(3))
        for lo in range(0, len(ids), 500):
            n += 1
            name, rows = f"part-{part:06d}-{n:06d}.arc", range(lo, min(lo + 500, len(ids)))
            arc = write_arc(1 + n % 2, name, [((urls[i] or "about:blank").translate(_URL_UNSAFE), arc_date(ids[i]), "text/html", b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (pages[i] or b"")) for i in rows])
            made = [to_warc(r, name) for r in read_arc(arc)][1:]
            cols = [
                [ids[i] for i in rows], *([m[k] for m in made] for k in ("record_id", "date", "uri", "head", "payload")),
                [len(m["payload"]) for m in made], *([m[k] for m in made] for k in ("payload_sha1", "block_sha1")),
            ]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _ROW.split(", ")])


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One converted record for each page, by way of legacy archives."""
    ship(pages.sparkSession)
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("row_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").cast("binary").alias("html")).mapInArrow(_convert, _ROW)


def arc_files(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the ARC files (plain or gzip) under ``path``, converted; each file is one task's work."""
    ship(spark)

    def read(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                data = inflate(data)
                for r in read_arc(data):
                    w = to_warc(r, name.rsplit("/", 1)[-1])
                    yield pa.RecordBatch.from_pylist([{"archive": name, **w}])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "archive string, record_id string, date string, type string, uri string, mime string, head binary, payload binary, block_sha1 string, payload_sha1 string")


def with_revisits(records: DataFrame, scratch: Scratch, least: int = REVISIT_BYTES) -> DataFrame:
    """``records`` (a written table) with type and, for revisits, refers_id, refers_record, refers_uri and refers_date of the winner."""
    own = F.struct(F.coalesce("row_id", F.lit(-(1 << 63))).alias("o"), "record_id", "row_id", "uri", "date")
    large = records.filter(F.col("payload_bytes") >= least)
    winners = scratch.put(large.groupBy("payload_sha1").agg(F.max(own).alias("w"), F.count("*").alias("n")).filter("n > 1").select("payload_sha1", "w"), "winners")
    again = (F.col("payload_bytes") >= least) & F.col("w").isNotNull() & (F.col("w.record_id") != F.col("record_id"))
    typed = records.join(winners, "payload_sha1", "left").withColumn("type", F.when(again, "revisit").otherwise("response"))
    for name, field in (("refers_id", "row_id"), ("refers_record", "record_id"), ("refers_uri", "uri"), ("refers_date", "date")):
        typed = typed.withColumn(name, F.when(again, F.col(f"w.{field}")))
    return typed


def warc_lines(rows: DataFrame) -> DataFrame:
    """The records' bytes without the closing separator, in one column ``value``."""
    crlf = "\r\n"
    revisit = F.col("type") == "revisit"
    http = F.coalesce(F.col("head"), F.lit(b""))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), "type"), F.concat(F.lit("WARC-Record-ID: <"), "record_id", F.lit(">")), F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "uri"), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_sha1"),
        F.when(~revisit, F.concat(F.lit("WARC-Block-Digest: sha1:"), "block_sha1")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{crlf}WARC-Refers-To: <"), "refers_record", F.lit(f">{crlf}WARC-Refers-To-Target-URI: "), "refers_uri", F.lit(f"{crlf}WARC-Refers-To-Date: "), "refers_date")),
        F.when(F.col("refers_id").isNotNull(), F.concat(F.lit("X-Refers-To-Row: "), F.col("refers_id").cast("string"))), F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(F.col("row_id").isNotNull(), F.concat(F.lit("X-Row: "), F.col("row_id").cast("string"))), F.concat(F.lit("Content-Length: "), F.length(body).cast("string")),
    ]
    head = F.concat(F.concat_ws(crlf, *lines), F.lit(crlf + crlf)).cast("binary")
    return rows.select(F.concat(head, body).cast("string").alias("value"))


def write_warc(rows: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    warc_lines(rows).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records_per_file(records: DataFrame) -> int:
    """As many records of mean size as make FILE_BYTES, RECORDS_PER_FILE at most."""
    mean = records.agg(F.avg("payload_bytes").alias("mean")).first().mean or 0
    return max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / (mean + 1024))))


def inflate(data: bytes) -> bytes:
    """Plain bytes of a file that may be gzip, with one or many members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a WARC file, plain or gzip of one or many members; one record is
    unpacked at a time."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    at = 0
    while first := source.readline():
        headers, size, line = {}, len(first), b""
        while True:
            line = source.readline()
            size += len(line)
            if line in (b"\r\n", b""):
                break
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        if not first.startswith(b"WARC/") or not line:
            raise ValueError(f"no record at {at}")
        n = int(headers["content-length"])
        block = source.read(n)
        if len(block) != n or source.read(len(END)) != END:
            raise ValueError(f"record at {at} is cut off")
        yield headers, block
        at += size + n + len(END)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string, date string"


def _read(batches):
    for b in batches:
        for content in b.column("content"):
            cols: list[list] = [[] for _ in range(8)]
            for h, block in read_records(content.as_py()):
                digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                if h["warc-type"] == "response":
                    payload = split_http(block)[1]
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"record {h['warc-record-id']} does not match its digest")
                num = [int(v) if (v := h.get(k)) is not None else None for k in ("x-row", "x-refers-to-row")]
                for c, v in zip(cols, (num[0], size, digest, h["warc-type"], num[1], h["warc-record-id"].strip("<>"), h["warc-target-uri"], h["warc-date"])):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _READ.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``; digests of responses are verified."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _READ)


def op4_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "warc")
    records = scratch.put(records_of(pages), "records")
    path = scratch.path("warc")
    write_warc(with_revisits(records, scratch), path, records_per_file(records))
    scratch.free(records)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
