"""WARC archives: written by tasks with one gzip member per record, read back by byte ranges.

``write_archives`` stores pages as records. Of pages with equal payloads of at least ``least_bytes`` the one with the
smallest id is a ``response``; the others ``revisit`` it and hold no payload. Digests are counted before the join
that tells every page its response, and that join is one Spark may split, so a payload that a third of all
pages share is no hot key. Each task writes archives of its own under the shared folder, under a name used by
one attempt only; the list of archives is a table that Spark commits, so files of failed attempts are never read.

``read_archives`` cuts the archives into byte ranges. A task looks for the gzip magic inside its range, decodes the
head of each candidate, and accepts it if it is a WARC record of that very archive; it owns the records that
start inside its range and reads beyond the end to finish the last one. What was read is counted against the
table of archives, so that no record is lost unseen. So one large archive is read by many
tasks, whatever the sizes of its records, and bytes that look like a member's start do no harm.

Defined cases: null html is an empty payload, a null url a record without target, a null id a record without
page id (response if no page with the same payload has an id, else a revisit); repeated rows of the smallest id
are responses each, of one record id; a url with characters that a header line cannot hold is escaped there and kept in a
header of its own; an empty table gives no archives and no rows. Further columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_schema
from rankloom.session import work_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive after which a task begins a new one.
ARCHIVE_BYTES = 256 << 20
#: Bytes read at a time, and compressed bytes looked at to decode a candidate's head.
READ_BYTES, HEAD_BYTES = 1 << 20, 1 << 14
MANIFEST = "path string, archive string, bytes long, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def response_id(page_id: int, payload: bytes) -> str:
    """The record id of a page's response: any task can tell it, so revisits name a record that is there."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest(payload)}')}>"


def _target(header: str, url: str) -> dict[str, str]:
    """The url as it is but for characters that a header line cannot hold, which are escaped."""
    return {header: "".join(c if c.isprintable() and not c.isspace() else quote(c) for c in url)}


def _record(
    archive: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool
) -> bytes:
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if revisit or page_id is None else response_id(page_id, payload),
        "WARC-Warcinfo-ID": f"<urn:uuid:{archive}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if url is not None:
        head |= _target("WARC-Target-URI", url)
        if head["WARC-Target-URI"] != url:
            head["X-Target-URI"] = quote(url, safe="")
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = response_id(refers_to, payload)
        head["X-Refers-To-Page"] = str(refers_to)
        if refers_url is not None:
            head |= _target("WARC-Refers-To-Target-URI", refers_url)
        block = b""
    else:
        head["Content-Type"] = "application/http; msgtype=response"
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head["Content-Length"] = str(len(block))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Store every page; the table of archives (path, archive, bytes, records), itself written."""
    spark = pages.sparkSession
    root, listed = work_path(spark, "warc"), work_path(spark, "warc-list")
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = (
        rows.where(F.length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    )
    told = rows.join(shared, "digest", "left").withColumn(
        "revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        out: dict[str, Any] = {}

        def close() -> Iterator[pa.RecordBatch]:
            if out:
                out["to"].close()
                yield pa.RecordBatch.from_pylist([{k: out[k] for k in ("path", "archive", "bytes", "records")}], schema=arrow_schema(MANIFEST))
                out.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "payload", "first", "first_url", "revisit")]
            for page_id, url, payload, first, first_url, revisit in zip(*columns, strict=True):
                if not out:
                    archive = str(uuid.uuid4())
                    name = f"{archive}.warc.gz"
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{archive}>\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                    out |= {"to": store.open_output_stream(f"{folder}/{name}", compression=None), "path": f"{root}/{name}", "archive": archive, "bytes": 0, "records": 0}
                    member = _member(info.encode())
                    out["to"].write(member)
                    out["bytes"] += len(member)
                member = _member(_record(out["archive"], page_id, url, payload, first, first_url, revisit))
                out["to"].write(member)
                out["bytes"] += len(member)
                out["records"] += 1
                if out["bytes"] >= archive_bytes:
                    yield from close()
        yield from close()

    told.select("id", "url", "payload", "first", "first_url", "revisit").mapInArrow(run, MANIFEST).write.parquet(listed)
    return spark.read.parquet(listed)


class _Window:
    """The bytes of a file from a place on, read in pieces as they are asked for."""

    def __init__(self, file: Any, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, bytearray()

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.data += self.file.read_at(max(end - have, min(READ_BYTES, self.size - have)), have)

    def get(self, start: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[start - self.start : min(end, self.size) - self.start])

    def forget(self, before: int) -> None:
        drop = before - self.start
        if drop >= READ_BYTES:
            del self.data[:drop]
            self.start = before


def _head(raw: bytes) -> dict[str, str] | None:
    """Headers of a record whose bytes begin with ``raw``; None if these are no whole headers of one."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    head = dict(line.split(": ", 1) for line in lines if ": " in line)
    return head if head.get("Content-Length", "").isdigit() else None


def _decode_head(window: _Window, at: int, archive: str) -> dict[str, str] | None:
    """The headers of the candidate member at ``at``, however long, if it is a record of this archive."""
    reader, raw, upto = zlib.decompressobj(31), bytearray(), at
    while True:
        # First what the last piece still holds beyond the output limit.
        piece = reader.unconsumed_tail
        if not piece:
            piece = window.get(upto, upto + HEAD_BYTES)
            upto += len(piece)
        seen = len(raw)
        try:
            raw += reader.decompress(piece, 1 << 20)
        except zlib.error:
            return None
        if not b"WARC/1.1\r\n".startswith(raw[:10]):
            return None
        if raw.find(b"\r\n\r\n", max(0, seen - 3)) >= 0 or reader.eof:
            head = _head(bytes(raw))
            return head if head and head.get("WARC-Warcinfo-ID") == f"<urn:uuid:{archive}>" else None
        if not piece and len(raw) == seen:
            return None


def _whole_member(window: _Window, at: int) -> tuple[bytes, int]:
    """The member's bytes, decoded, and where the next one begins."""
    reader, parts, upto = zlib.decompressobj(31), [], at
    while not reader.eof:
        piece = window.get(upto, upto + READ_BYTES // 4)
        if not piece:
            raise EOFError(f"archive ends inside the member at byte {at}")
        parts.append(reader.decompress(piece))
        upto += len(piece)
    return b"".join(parts), upto - len(reader.unused_data)


def records_in(file: Any, size: int, start: int, end: int, archive: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records that start in ``[start, end)``."""
    window, at = _Window(file, start, size), start
    while at < end:
        # A magic number may lie across the end of what was read; one that starts at ``end`` belongs to the next range.
        window.upto(min(end, at + READ_BYTES) + len(MAGIC) - 1)
        found = window.data.find(MAGIC, at - window.start, min(end, at + READ_BYTES) + len(MAGIC) - 1 - window.start)
        if found < 0:
            at = min(end, at + READ_BYTES)
            window.forget(at)
            continue
        at = window.start + found
        if at >= end:
            return
        if _decode_head(window, at, archive) is None:
            at += 1
            continue
        raw, at = _whole_member(window, at)
        cut = raw.find(b"\r\n\r\n") + 4
        head = _head(raw)
        yield head, raw[cut : cut + int(head["Content-Length"])]
        window.forget(at)


def read_archives(archives: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """One row per record but the archives' own: (page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, sound). ``sound``: a response's payload has the length and digest its headers say. The rows are
    written and counted first; an archive with other than its listed number of records is an error."""
    ranges = archives.select(
        "path", "archive", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(int(range_bytes)).cast("long"))).alias("start")
    )
    tasks = max(1, min(ranges.count(), 20_000))
    found = f"archive string, {RECORD}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, archive, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "archive", "size", "start")), strict=True):
                store, place = pafs.FileSystem.from_uri(path)
                rows: list[dict[str, Any]] = []
                with store.open_input_file(place) as file:
                    for head, block in records_in(file, size, start, min(start + range_bytes, size), archive):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        sound = True
                        if kind == "response":
                            payload = block[block.find(b"\r\n\r\n") + 4 :]
                            sound = (len(payload), payload_digest(payload)) == (length, digest)
                            digest, length = payload_digest(payload), len(payload)
                        page, refers, url, escaped = (head.get(k) for k in ("X-Page-ID", "X-Refers-To-Page", "WARC-Target-URI", "X-Target-URI"))
                        url = url if escaped is None else unquote(escaped)
                        rows.append({
                            "archive": archive, "page_id": int(page) if page else None, "url": url, "payload_bytes": length, "payload_digest": digest,
                            "record_type": kind, "refers_to": int(refers) if refers else None, "sound": sound,
                        })
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema(found))
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema(found))

    spark, path = archives.sparkSession, work_path(archives.sparkSession, "warc-read")
    ranges.repartition(tasks, "path", "start").mapInArrow(run, found).write.parquet(path)
    records = spark.read.schema(found).parquet(path)
    read = records.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    wrong = archives.select("path", "archive", "records").join(read, "archive", "left").where(n != F.col("records")).select("path", "records", n.alias("n")).first()
    if wrong:
        raise ValueError(f"{wrong.path} lists {wrong.records} records, {wrong.n} were read")
    return records.drop("archive")
