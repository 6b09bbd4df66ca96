"""Operator 6: a converter of legacy ARC archives to WARC.

An ARC file starts with a version block (``filedesc://``) whose body names the
fields of the header lines that follow: five in version 1, ten in version 2.
Each record is a header line and as many bytes as its last field declares. The
converter parses these, and makes WARC records of them: an identifier derived
from the file's name and the record's offset, the time in ISO form, a type by
the scheme of the address, and SHA-1 digests of block and payload. Records
whose payloads are equal and not small become revisits of the one with the
largest key. The archives are written by Spark's text writer (a record ends in
two line breaks), of at most ``ARCHIVE_RECORDS`` records each, whatever a task
holds, and read back one by one, by declared lengths. Long payloads are records
like any other, and equal keys with equal payloads are all originals.

``key`` is a number that the record's HTTP head carries (``KEY_HEADER``); null
where it has none. Records of payloads below ``MIN_REVISIT`` bytes, without a key
or not of HTTP stay whole. Of repeated rows with the largest key each is a
response. Null addresses and payloads are empty ones. A header line that is
not of its version ends the reading of its file with an error, since what
follows has no known place; a record cut short by the end of the file keeps
the bytes that are there and says so. An empty table gives archives without
records. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, scratch, small_pieces, stored

MIN_REVISIT = 1000
KEY_HEADER = "X-Page-Id"
#: The fields of the header lines of either version.
FIELDS = {"1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
          "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive made from a table, about.
ARCHIVE_BYTES = 4 << 20
#: Records of a written archive at most: pages of a megabyte on average fill half a gigabyte.
ARCHIVE_RECORDS = 512
FILES = "name string, content binary"


def arc_files(pages: DataFrame) -> DataFrame:
    """Legacy archives (name, content) that hold the pages, in version 1 and 2
    by turns: input of the converter where a table stands for a crawl."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, content, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            version = "12"[k % 2]
            body = f"{version} 0 Crawl\n{' '.join(FIELDS[version])}\n".encode()
            name = f"pages-{part:05d}-{k:05d}.arc"
            more = f" 200 - - 0 {name}" if version == "2" else ""
            records = [f"filedesc://{name} 0.0.0.0 20000101000000 text/plain{more} {len(body)}\n".encode() + body]
            for url, head, html, date in content:
                records.append(f"{url} 0.0.0.0 {date} text/html{more} {len(head) + len(html)}\n".encode() + head + html)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"\n".join(records) + b"\n"], pa.binary())], ["name", "content"])

        for b in small_pieces(batches):
            for key, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), as_bytes(b.column("html"))):
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{KEY_HEADER}: {key}\r\n" if key is not None else "") + f"Content-Length: {len(html)}\r\n\r\n"
                content.append((re.sub(r"\s", "%20", url or "unknown:"), head.encode(), html, f"2000{1 + (key or 0) % 12:02d}01{(key or 0) % 24:02d}0000"))
                size += len(html)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    k, content, size = k + 1, [], 0
        if content:
            yield closed()

    return arrow_pass(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, FILES)


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bool]]:
    """Offset, header fields, block and whether it is whole, of each record."""
    content, at, fields, first = unpacked(content), 0, FIELDS["1"], True
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].decode("utf-8", errors="replace").rstrip("\r")
        if first and line.startswith("filedesc://"):
            # the body's first line has the version, its second one the fields
            body = content[end + 1 :].split(b"\n", 2)
            fields = FIELDS.get(body[0].split(b" ")[0].decode(), FIELDS["1"])
        parts = line.rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"no header line of {len(fields)} fields at byte {at}: {line[:200]!r}")
        block = content[end + 1 : end + 1 + int(parts[-1])]
        yield at, dict(zip(fields, parts)), block, len(block) == int(parts[-1])
        at, first = end + 1 + int(parts[-1]), False


def iso(date: str) -> str:
    """The time of an ARC date of 4 to 14 digits."""
    d = date + "00000101000000"[len(date):] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1(data: bytes) -> tuple[str, str]:
    digest = hashlib.sha1(data).digest()
    return digest.hex(), "sha1:" + base64.b32encode(digest).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head, with the blank line that ends it, and payload."""
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = block.find(mark)
        if at >= 0:
            return block[: at + len(mark)], block[at + len(mark) :]
    return block, b""


def key_of(head: bytes) -> int | None:
    found = re.search(rb"(?im)^" + KEY_HEADER.encode() + rb":[ \t]*(-?\d+)[ \t]*\r?$", head)
    return int(found[1]) if found else None


RECORDS = ("record_id string, kind string, uri string, date string, ip string, content_type string, key long, payload_bytes long, sha1 string, "
           "payload_digest string, block_digest string, whole boolean, head binary, payload binary")


def converted(files: DataFrame) -> DataFrame:
    """The records of ARC files (name, content) as the parts of WARC records."""
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    kinds = [*[pa.string()] * 6, pa.int64(), pa.int64(), *[pa.string()] * 3, pa.bool_(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out: list[list] = [[] for _ in names]
                name, size = b.column("name")[i].as_py() or "", 0
                for k, (at, fields, block, whole) in enumerate(arc_records(b.column("content")[i].as_py() or b"")):
                    uri, kind, content_type, head, payload = fields["URL"], "resource", fields["Content-type"], b"", block
                    if k == 0 and uri.startswith("filedesc://"):
                        kind, content_type = "warcinfo", "application/warc-fields"
                    elif block.startswith(b"HTTP/"):
                        kind, content_type = "response", "application/http; msgtype=response"
                        head, payload = http_parts(block)
                    elif uri.startswith("dns:"):
                        kind, content_type = "response", "text/dns"
                    digest = sha1(payload)
                    row = (f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}')}>", kind, uri, iso(fields["Archive-date"]), fields["IP-address"], content_type, key_of(head), len(payload), *digest, sha1(block)[1], whole, head, payload)
                    for o, v in zip(out, row):
                        o.append(v)
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names)
                        out, size = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names)

    return arrow_pass(files, run, RECORDS)


def revisited(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Records with original (struct of key, record_id, uri, date), which is
    null for those that stay whole."""
    able = (F.col("kind") == "response") & F.col("key").isNotNull() & (F.col("payload_bytes") >= min_bytes) & F.col("whole")
    first = records.where(able).groupBy("sha1").agg(F.max(F.struct("key", "record_id", "uri", "date")).alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select("sha1", "first"), "warc-first")
    out = records.join(first, "sha1", "left")
    return out.withColumn("original", F.when(able & (F.col("key") < F.col("first.key")), F.col("first"))).drop("first")


def _text(c: Column) -> Column:
    return c.cast("string")


def warc_text(records: DataFrame) -> DataFrame:
    """The one column of WARC records as the archive holds them, without the
    two line breaks that end each."""
    again = F.col("original").isNotNull()
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    web = F.when(F.col("kind") != "warcinfo", F.col("uri"))
    parts = [F.lit("WARC/1.1\r\n"),
             line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("kind"))), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
             line("WARC-Target-URI", web), line("WARC-IP-Address", F.when(F.col("kind") != "warcinfo", F.col("ip"))),
             line("WARC-Payload-Digest", F.when(F.col("kind") != "warcinfo", F.col("payload_digest"))), line("WARC-Block-Digest", F.when(~again, F.col("block_digest"))),
             line("WARC-Profile", F.when(again, F.lit(PROFILE))), line("WARC-Refers-To", F.col("original.record_id")),
             line("WARC-Refers-To-Target-URI", F.col("original.uri")), line("WARC-Refers-To-Date", F.col("original.date")),
             line("WARC-Truncated", F.when(~F.col("whole"), F.lit("unspecified"))), line("Content-Type", F.col("content_type")),
             line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n")]
    # the writer adds line breaks itself, as bytes, so a payload need not be text
    return records.select(_text(F.concat(*(p.cast("binary") for p in parts), block)).alias("value"))


def written(records: DataFrame, path: str) -> None:
    """Write archives; a task of many records begins a new one as often as needed."""
    warc_text(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    content, at = unpacked(content), 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in content[at:end].decode("utf-8", errors="replace").split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        size = int(fields["content-length"])
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size


READ = "record_id string, kind string, uri string, key long, payload_bytes long, sha1 string, refers_to_id string, digest_holds boolean"


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC archives below ``path``, their digests made anew
    from the payloads; a revisit's is what its header says."""
    names = [x.split(" ")[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out: list[list] = [[] for _ in names]
                for fields, block in warc_records(b.column("content")[i].as_py()):
                    head, payload = http_parts(block) if block.startswith(b"HTTP/") else (b"", block)
                    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "")
                    if kind == "revisit":
                        n, digest, holds = None, base64.b32decode(said.removeprefix("sha1:")).hex(), True
                    else:
                        digest, coded = sha1(payload)
                        n, holds = len(payload), said in ("", coded)
                    for o, v in zip(out, (fields["warc-record-id"], kind, fields.get("warc-target-uri"), key_of(head), n, digest, fields.get("warc-refers-to"), holds)):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_pass(files, run, READ)


def resolved(read: DataFrame) -> DataFrame:
    """Read records other than warcinfo, revisits with key (``refers_to``) and
    payload_bytes of the record that they refer to."""
    read = read.where("kind <> 'warcinfo'")
    first = read.where("kind <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"))
    out = read.join(first, "refers_to_id", "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "first_bytes")).drop("first_bytes")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each
    page: pages to ARC files, these converted to WARC archives, these read."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    written(revisited(converted(arc_files(pages))), path)
    read = stored(read_back(spark, path), "warc-read")
    return resolved(read).select(F.col("key").alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "digest_holds")
