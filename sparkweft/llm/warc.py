"""WARC archives: one gzip member for each record, written and read sequentially on Spark.

Archives are files of up to ``archive_bytes``, made in the tasks and written by Spark to the
shared folder, so that any store that Spark writes will do. Spark's text writer puts the bytes
as they are and one zero byte after the last member, which is gzip's padding. Reading takes the
files as Spark's binaryFile rows, decompresses them incrementally, frames blocks by their
Content-Length and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, raw

STAMP = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PADDING = "\0"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    digits = (name or "")[10:-1]
    return int(digits) if digits else None


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """A record as a gzip member; a revisit's block is the HTTP head alone."""
    head = HTTP % len(payload)
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", STAMP),
        ("WARC-Target-URI", " ".join((url or "").split())), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_32(block)}")]
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(data, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Each gzip member, decompressed chunk by chunk; zero bytes between members are padding."""
    view, at = memoryview(data), 0
    while True:
        while at < len(view) and view[at] == 0:
            at += 1
        if at >= len(view):
            return
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("a gzip member ends early")
            part = view[at : at + chunk]
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> dict:
    """Frames a record by its Content-Length and verifies its digests."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the block")
    if f"sha1:{sha1_32(block)}" != fields["warc-block-digest"]:
        raise ValueError("the block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or f"sha1:{sha1_32(payload)}" != fields["warc-payload-digest"]):
        raise ValueError("the payload digest differs")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": fields["warc-payload-digest"][5:],
        "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to")) if revisit else None, "payload": None if revisit else payload}


def write_archives(pages: DataFrame, scratch: Scratch, min_revisit: int = 0, archive_bytes: int = 16 << 20) -> str:
    """Writes a record for every row of ``pages`` (page_id, url, html); returns the folder.

    The payload is the html in UTF-8 (null: empty). Of rows with one payload of at least
    ``min_revisit`` bytes the smallest page_id is the response (null ids last; of repeated rows
    of that id each is a response), the others revisit it. Rows meet by digest only as a minimum
    that is combined before the shuffle, so a payload's copies never gather.
    """
    rows = pages.select("page_id", "url", raw("html").alias("payload"))
    rows = rows.withColumn("_digest", F.sha1("payload")).withColumn("_bytes", F.length("payload"))
    first = rows.where(F.col("_bytes") >= min_revisit).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    marked = rows.join(first, "_digest", "left")

    def pack(batches):
        made, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, head in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "_digest", "_first"))):
                refers = None if head is None or head == page_id else record_id(head)
                made.append(member(page_id, url, payload, refers, base64.b32encode(bytes.fromhex(digest)).decode()))
                size += len(made[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(made)], pa.binary())})
                    made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(made)], pa.binary())})

    archives = marked.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    path = f"{scratch.base}/warc-{uuid.uuid4().hex}"
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", PADDING).text(path)
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in a folder; raises where one is damaged."""
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in kept])
    sql = ", ".join(f"{c} {'binary' if c == 'payload' else 'long' if c in kinds else 'string'}" for c in kept)

    def read(batches):
        for batch in batches:
            for data in batch["content"]:
                rows, size = [], 0
                for record in members(data.as_buffer()):
                    row = parse(record)
                    rows.append({c: row[c] for c in kept})
                    size += len(record) if payloads else 256
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, sql)


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes the archives and reads them back: a row for every page. No pages, no rows."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, scratch, min_revisit))
