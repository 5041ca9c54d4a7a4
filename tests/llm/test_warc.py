import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from presswork.llm import queries, warc


def plain(rows, least=0):
    """(page_id, html) rows -> (page_id, bytes, digest, type, refers_to)."""
    payload = [(i, (h or "").encode()) for i, h in rows]
    largest = {}
    for i, p in payload:
        if i is not None and len(p) >= least:
            largest[p] = max(largest.get(p, i), i)
    result = []
    for i, p in payload:
        first = largest.get(p) if i is not None else None
        again = first is not None and i < first
        result.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                       "revisit" if again else "response", first if again else None))
    return sorted(result, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows],
                                     "page_id long, url string, html string, digest string, size int")
    return make


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


HARD = [(1, None, None), (2, "http://a/ b\r\nX: y", ""), (3, "é", "same"), (4, "u", "same"), (4, "u", "same"),
        (5, "u", "é" * 5000), (None, "u", "same"), (-6, "u", "WARC/1.1\r\n\r\n"), (7, "u", "\r\n\r\n" * 9),
        (8, "u", "x" * 300_000), (9, "u", "x" * 300_000)]


def test_hard_rows(pages):
    assert result(warc.archive(pages(HARD))) == plain([(i, h) for i, _, h in HARD])
    assert result(warc.archive(pages(HARD), min_bytes=5)) == plain([(i, h) for i, _, h in HARD], 5)
    assert result(warc.archive(pages([]))) == []


@pytest.mark.parametrize("chunk, file_bytes, segment", [(1, 400, 100), (7, 10_000, 900), (64, 1 << 30, 2000)])
def test_small_chunks_files_and_segments(pages, chunk, file_bytes, segment):
    rng = random.Random(chunk)
    rows = [(i, f"http://h/{i}", rng.choice(["", "abc", "é" * rng.randrange(60), f"\r\nWARC/1.1 {i}"]))
            for i in range(60)]
    segments = warc.write_archives(warc.records(pages(rows)), chunk=chunk, file_bytes=file_bytes,
                                   segment_bytes=segment)
    assert segments.count() > 1
    got = warc.read_archives(segments, chunk).collect()
    whole, texts = {}, {i: h for i, _, h in rows}
    for r in got:
        whole.setdefault(r.record_id, []).append(r)
    assert len(whole) == len(rows)
    for name, parts in whole.items():
        text = texts[int(name.rsplit(":", 1)[1])].encode()
        assert [p.chunk_no for p in parts] == list(range(len(parts)))
        assert all(len(p.data) <= chunk for p in parts) and [p.last for p in parts][-1]
        if parts[0].record_type == "response":
            assert b"".join(bytes(p.data) for p in parts) == text
            for n, p in enumerate(parts):
                sha = hashlib.sha1(text[:(n + 1) * chunk]).digest()
                assert p.digest == base64.b32encode(sha).decode()
        assert parts[0].payload_bytes == len(text)


def test_archive_file_is_a_warc(pages):
    segments = warc.write_archives(warc.records(pages([(2, "http://a/ \n", "body"), (1, "u", "body")])))
    data = b"".join(open(r.path.removeprefix("file:"), "rb").read() for r in
                    segments.select("path").distinct().collect())
    assert data.count(b"WARC/1.1\r\n") == 2 and b"WARC-Target-URI: http://a/%20%0A\r\n" in data
    assert b"WARC-Refers-To: <urn:page:2>\r\n" in data and b"\r\n\r\nbody\r\n\r\n" in data


def test_a_damaged_payload_is_an_error(pages):
    rows = warc.records(pages([(1, "u", "body")])).withColumn("payload", F.encode(F.lit("b0dy"), "utf-8"))
    with pytest.raises(Exception, match="do not make its payload"):
        warc.write_archives(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert result(queries.QUERIES["op5_warc"](spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == plain(rows)
