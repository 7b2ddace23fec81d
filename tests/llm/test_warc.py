import base64
import gzip
import hashlib
import io
import random
import tracemalloc
import zlib

import pytest

from driftframe.llm import queries, warc
from driftframe.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows):
    first = {}
    for page, data in rows:
        first[data] = min(first.get(data, page), page)
    return {(page, len(data), digest(data), "response" if first[data] == page else "revisit", None if first[data] == page else first[data]) for page, data in rows}


def test_op7(spark):
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert {tuple(r) for r in queries.op7_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == expected(rows)


def test_chunks_join_to_payloads(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 70_000, rng.randbytes(90_000).hex(), "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n", "a", "\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"https://x.net/ {i}", t, "c") for i, t in enumerate(texts)], "page_id long, url string, html string, chunk string")
    rows = warc.archive_and_read(pages, 1000).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.page_id == i), key=lambda r: r.chunk_no)
        data = (t or "").encode()
        assert [r.is_last for r in own] == [False] * (len(own) - 1) + [True] and own[-1].payload_bytes == len(data) and own[-1].payload_digest == digest(data)
        if own[0].record_type == "response":
            assert b"".join(r.chunk for r in own) == data and all(len(r.chunk) <= 1000 for r in own)
            at = 0
            for r in own:  # incremental digests
                at += len(r.chunk)
                assert r.size_so_far == at and r.sha1_so_far == digest(data[:at])
        else:
            assert own[0].chunk is None and own[0].refers_to == {1: 0, 6: 2}[i]


def test_odd_tables(spark):
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([(7, None, "x"), (7, None, "x"), (None, "u", "x"), (None, "u", "only"), (8, "u", "x")], schema)
    rows = warc.archive_and_read(pages).collect()
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in rows)
    assert kinds == [("7", "response", "None")] * 2 + [("8", "revisit", "7"), ("None", "response", "None"), ("None", "revisit", "7")]
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_files_are_plain_warc(spark):
    pages = spark.createDataFrame([(3, "https://x.net/é", "body")], "page_id long, url string, html string")
    uri = scratch_path(spark, "warc-test")
    made = warc.write(pages, uri if "://" in uri else f"file://{uri.removeprefix('file:')}").collect()
    data = gzip.decompress(open(made[0].path.removeprefix("file:").replace("//", "/", 1), "rb").read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\nbody\r\n\r\n") and made[0].records == 1


def test_reader_takes_other_records_and_plain_files():
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    page = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:-4>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    for data in (info + page, gzip.compress(info) + gzip.compress(page)):
        rows = list(warc.records(io.BytesIO(data), 3))
        assert [r[4] for r in rows] == [b"hel", b"lo"] and rows[-1][:2] == (-4, "response") and rows[-1][8:] == (5, digest(b"hello"))
    for bad in (page[:-12], gzip.compress(page)[:-20], b"junk\r\n"):
        with pytest.raises((warc.WarcError, KeyError)):
            list(warc.records(io.BytesIO(bad)))


def test_an_oversized_record_is_streamed():
    """A payload of 150 MB, read from a gzip member with a few MB of memory."""
    size, part = 150 << 20, bytes(range(256)) * 4096
    archive, pack = io.BytesIO(), zlib.compressobj(1, zlib.DEFLATED, 31)
    head = b"".join(warc._record(5, "http://a.org/", "X" * 32, size, None, True))
    archive.write(pack.compress(head))
    sha1 = hashlib.sha1()
    for _ in range(size // len(part)):
        archive.write(pack.compress(part))
        sha1.update(part)
    archive.write(pack.compress(b"\r\n\r\n") + pack.flush())
    archive.seek(0)
    tracemalloc.start()
    last, n = None, 0
    for last in warc.records(archive):
        n += 1
        assert len(last[4]) <= warc.CHUNK
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == size // warc.CHUNK and last[5] == last[8] == size and last[9] == base64.b32encode(sha1.digest()).decode() and peak < 8 << 20


def test_places_of_archives(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert warc._store(f"file:{tmp_path}")[1] == warc._store(f"file://{tmp_path}")[1] == str(tmp_path)
    with pytest.raises(warc.WarcError):
        warc._store("odd://x/y")


def test_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    test_odd_tables(spark)
