"""WARC archives written and read back as tables of payload chunks.

Payloads travel as rows of a record identifier and a chunk number, so that
neither the writer nor the reader holds a whole record: the writer streams chunk
after chunk into its file, the reader gives every chunk with the digest of the
payload as far as it has come, the last one's being that of the payload.
"""

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stored

CHUNK = 1 << 18
#: A reading task gets about so many bytes of an archive, a file holds about so many.
SEGMENT = 1 << 25
FILE = 1 << 30
#: Tasks that read at most; with more segments each reads several.
READERS = 8192
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The digits of bases 32 as Spark counts and as RFC 4648 does.
COUNTED, NAMED = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: 40 bits, or 10 hexadecimal digits, are 8 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), COUNTED, NAMED)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_bytes: int = MIN_BYTES) -> DataFrame:
    """What to write: page_id, url, digest, size, refers_to, payload (null for a revisit).

    Of equal payloads of at least ``min_bytes`` bytes, all but that of the
    largest id are revisits that refer to it. Null payloads are empty ones. A
    row with a null id is never a revisit, and nothing refers to it; repeated
    rows with the largest id are all responses.

    Groups are aggregated before the shuffle, and the join back has a plain
    shuffle on both sides that Spark can split.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                         body.alias("payload"))
            .withColumn("digest", base32_sha1(F.col("payload")))
            .withColumn("size", F.octet_length("payload").cast("long")))
    groups = stored(
        rows.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("page_id").alias("_first"), F.min("page_id").alias("_least"))
        .where("_least < _first").select("_digest", "_first"), "payload-groups")
    again = F.col("page_id") < F.col("_first")
    return (rows.join(groups, (rows["digest"] == groups["_digest"]) & (rows["size"] >= min_bytes), "left")
            .select("page_id", "url", "digest", "size",
                    F.when(again, F.col("_first")).alias("refers_to"),
                    F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload")))


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``chunk_no`` and ``data`` in place of the payload; one row at least, in order."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    numbered = rows.withColumn("chunk_no", F.explode(F.sequence(
        F.lit(0), F.coalesce(count, F.lit(1)) - 1)))
    return numbered.withColumn("data", F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})")
                               ).drop("payload")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _head(row: dict, date: str) -> bytes:
    """The header of a record and the HTTP header that begins its block."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['size']}\r\n\r\n").encode()
    revisit = row["refers_to"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
        lines.append(f"WARC-Target-URI: {url}")
    if revisit:
        lines += [f"WARC-Refers-To: {_name(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{row['digest']}",
              "Content-Type: application/http;msgtype=response",
              f"Content-Length: {len(http) + (0 if revisit else row['size'])}", "", ""]
    return "\r\n".join(lines).encode() + http


def write_archives(rows: DataFrame, date: str = DATE, chunk: int = CHUNK,
                   file_bytes: int = FILE, segment_bytes: int = SEGMENT) -> DataFrame:
    """Writes the result of :func:`records` as WARC files; gives path, start, end of their segments.

    The files lie in the folder that executors share. Each task writes files of
    its own with a name that no other attempt has; only the returned segments
    say which files count, so what a lost task leaves behind is never read. The
    folder must be one that pyarrow opens (a shared file system, HDFS, S3).
    """
    folder = fresh(rows.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, base = FileSystem.from_uri(folder)
        out, path, at, begun, done, sha, owed = None, "", 0, 0, [], None, 0

        def ended():
            nonlocal begun
            if at > begun:
                done.append((path, begun, at))
                begun = at

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is not None and at >= file_bytes:
                        ended()
                        out.close()
                        out = None
                    if out is None:
                        system.create_dir(base, recursive=True)
                        path, at, begun = f"{base}/{uuid.uuid4().hex}.warc", 0, 0
                        out = system.open_output_stream(path)
                    if at - begun >= segment_bytes:
                        ended()
                    head, sha = _head(row, date), hashlib.sha1()
                    owed = 0 if row["refers_to"] is not None else row["size"]
                    out.write(head)
                    at += len(head)
                data = row["data"] or b""
                out.write(data)
                sha.update(data)
                at, owed = at + len(data), owed - len(data)
                if owed == 0:
                    if row["refers_to"] is None and base64.b32encode(sha.digest()).decode() != row["digest"]:
                        raise ValueError(f"the chunks of page {row['page_id']} do not make its payload")
                    out.write(b"\r\n\r\n")
                    at += 4
        if out is not None:
            ended()
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[i] for d in done]) for i in range(3)], ["path", "start", "end"])

    return stored(chunks(rows, chunk).mapInArrow(write, "path string, start long, end long"),
                  "segments").withColumn("folder", F.lit(folder))


class _Records:
    """Parses the records of a segment, holding one chunk at a time."""

    def __init__(self, source, end: int, chunk: int):
        self.source, self.end, self.chunk, self.held = source, end, chunk, b""

    def line(self) -> bytes:
        while b"\r\n" not in self.held:
            more = self.source.read(4096)
            if not more:
                raise ValueError("a record ends in its header")
            self.held += more
        line, self.held = self.held.split(b"\r\n", 1)
        return line

    def take(self, count: int) -> bytes:
        if len(self.held) < count:
            self.held += self.source.read(count - len(self.held))
        if len(self.held) < count:
            raise ValueError("a record ends in its block")
        data, self.held = self.held[:count], self.held[count:]
        return data

    def fields(self) -> dict[str, str]:
        found = {}
        while line := self.line():
            name, _, value = line.decode().partition(":")
            found[name.lower()] = value.strip()
        return found

    def __iter__(self) -> Iterator[dict]:
        while self.source.tell() - len(self.held) < self.end:
            if not self.line().startswith(b"WARC/"):
                raise ValueError("a record does not begin where one should")
            warc = self.fields()
            size = int(warc["content-length"])
            before = self.source.tell() - len(self.held)
            self.line()
            http = self.fields()
            size -= self.source.tell() - len(self.held) - before
            row = {"record_id": warc["warc-record-id"].strip("<>"), "record_type": warc["warc-type"],
                   "url": warc.get("warc-target-uri"),
                   "refers_to": warc.get("warc-refers-to", "").strip("<>") or None,
                   "declared": warc["warc-payload-digest"].removeprefix("sha1:"),
                   "payload_bytes": int(http["content-length"])}
            sha, number, left = hashlib.sha1(), 0, size
            while number == 0 or left:
                data = self.take(min(left, self.chunk))
                sha.update(data)
                left -= len(data)
                yield row | {"chunk_no": number, "data": data, "last": not left,
                             "digest": base64.b32encode(sha.digest()).decode()}
                number += 1
            if self.take(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where it should")


CHUNK_ROWS = ("record_id string, record_type string, url string, refers_to string, declared string, "
              "payload_bytes long, chunk_no int, data binary, last boolean, digest string")


def read_archives(segments: DataFrame, chunk: int = CHUNK, readers: int = READERS) -> DataFrame:
    """The records of the segments as rows of record and chunk, in order within a record.

    ``digest`` is that of the payload up to and with the chunk, ``declared`` that
    of the header; a response whose last digest is another is an error. A revisit
    has one chunk without data. ``payload_bytes`` is the length of the whole payload.
    Up to ``readers`` tasks read one segment each, more segments are dealt to these.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        schema = pa.schema([
            ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
            ("refers_to", pa.string()), ("declared", pa.string()), ("payload_bytes", pa.int64()),
            ("chunk_no", pa.int32()), ("data", pa.binary()), ("last", pa.bool_()), ("digest", pa.string())])
        held, size = [], 0
        for batch in batches:
            for segment in batch.to_pylist():
                system, _ = FileSystem.from_uri(segment["folder"])
                with system.open_input_file(segment["path"]) as source:
                    source.seek(segment["start"])
                    for row in _Records(source, segment["end"], chunk):
                        if row["record_type"] == "response" and row["last"] and row["digest"] != row["declared"]:
                            raise ValueError(f"the payload of {row['record_id']} has another digest")
                        held.append(row)
                        size += len(row["data"])
                        if size > 1 << 22 or len(held) > 4096:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    tasks = max(1, min(segments.count(), readers))
    return segments.repartition(tasks, "path", "start").mapInArrow(read, CHUNK_ROWS)


def page_number(name: Column) -> Column:
    """The page id in a record's name, null for "none"."""
    return F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the pages as archives and reads these: one row per page, as its record says."""
    chunk_rows = read_archives(write_archives(records(pages, min_bytes=min_bytes)))
    return chunk_rows.where("last").select(
        page_number(F.col("record_id")).alias("page_id"), "payload_bytes",
        F.when(F.col("record_type") == "revisit", F.col("declared")).otherwise(F.col("digest"))
        .alias("payload_digest"), "record_type", page_number(F.col("refers_to")).alias("refers_to"))
