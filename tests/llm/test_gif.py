import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from driftframe.llm import gif, queries

SF = "/root/testdata/sf0.001"


def test_op3(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_gif(spark, SF).collect()
    for r in rows:
        data = docs.pop(r.doc_id)
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = gif.encode(data)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature
    assert not docs


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 1152, 1153, 40_000])
def test_round_trip(size):
    for data in (bytes(size), random.Random(size).randbytes(size), b"abcab" * (size // 5)):
        media = gif.encode(data, delay=7)
        back, colours, ms = gif.read_back(media)
        assert back == gif.payload(data) and sum(colours) >= len(back) and ms == 70 * -(-len(back) // 1152)
    assert len(gif.encode(bytes(40_000))) < 6_000


def test_streams_side_by_side_are_those_of_plain_loops():
    rng, streams = random.Random(1), []
    parts = [rng.choice([rng.randbytes(1152), bytes(1152), b"the quick brown fox " * 57 + b"0123456789ab", bytes(rng.choice(b"ab") for _ in range(1152))]) for _ in range(30)]
    assert gif.lzw_encode_many(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 1152)) == [gif.lzw_encode(p, 8) for p in parts]
    for _ in range(40):  # code sizes, full tables and clears, ends and cuts at different places
        size, n = rng.choice([2, 3, 5, 8]), rng.choice([1, 2, 10, 500, 5000, 30_000])
        data = rng.choice([bytes(rng.randrange(1 << size) for _ in range(n)), bytes(n), bytes(k // 7 % (1 << size) for k in range(n))])
        stream = gif.lzw_encode(data, size)
        streams += [(stream, size, n), (stream, size, max(1, n // 2)), (stream[: len(stream) // 2], size, n), (rng.randbytes(20) + stream, size, n)]
    for got, want in zip(gif.lzw_decode_many(*map(list, zip(*streams))), (gif._or_error(*x) for x in streams), strict=True):
        assert isinstance(got, gif.GifError) == isinstance(want, gif.GifError) and (isinstance(want, gif.GifError) or got.tobytes() == want.tobytes())


def test_media_of_a_batch_are_those_of_one():
    texts = [b"", b"x" * 577, random.Random(2).randbytes(5000), b"abc " * 3000]
    media = gif.encode_many(texts)
    assert media == [gif.encode(t) for t in texts] and gif.read_back_many(media) == [gif.read_back(m) for m in media]


@pytest.mark.parametrize("size", [2, 3, 5, 8])
def test_lzw(size):
    rng = random.Random(size)
    for n in (1, 2, 10, 5000, 60_000):  # the longest fills the table and clears it
        for data in (bytes(rng.randrange(1 << size) for _ in range(n)), bytes(n), bytes(k // 7 % (1 << size) for k in range(n))):
            assert gif.lzw_decode(gif.lzw_encode(data, size), size, n).tobytes() == data


def image(frames, screen=(4, 4), palette=b"\xff\0\0\0\xff\0\0\0\xff\0\0\0"):
    """frames: (disposal, transparent, left, top, width, height, flags, local palette, indices)."""
    out = b"GIF89a" + struct.pack("<HHBBB", *screen, 0x81, 0, 0) + palette
    for disposal, clear, left, top, w, h, flags, local, indices in frames:
        stream = gif.lzw_encode(bytes(indices), 2)
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 5, clear or 0, 0) + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + b"\x02" + bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def test_palettes_disposal_and_transparency():
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    full = [0] * 16
    frames = list(gif.decode(image([
        (1, None, 0, 0, 4, 4, 0, b"", full), (3, None, 1, 1, 2, 2, 0, b"", [1] * 4), (2, 2, 0, 0, 2, 2, 0, b"", [2, 1, 1, 2]), (0, None, 3, 3, 1, 1, 0x81, b"\x07\x08\x09" + bytes(9), [0]),
    ])))
    assert [f.start_ms for f in frames] == [0, 50, 100, 150] and [f.disposal for f in frames] == [1, 3, 2, 0]
    assert (frames[0].rgb == red).all() and (frames[1].rgb[1:3, 1:3] == green).all()
    third = frames[2]  # the square of the second is gone, index 2 of the third is clear
    assert tuple(third.rgb[0, 0]) == red and tuple(third.rgb[0, 1]) == green and tuple(third.rgb[2, 2]) == red
    last = frames[3]  # the box of the third is clear, a local palette is used
    assert not last.shown[:2, :2].any() and last.shown[2:, 2:].all() and tuple(last.rgb[3, 3]) == (7, 8, 9)
    assert gif.histogram(frames[0])[3 << 4] == 16 and sum(gif.histogram(last)) == 12 and blue


def test_interlacing():
    rows = [*range(0, 16, 8), *range(4, 16, 8), *range(2, 16, 4), *range(1, 16, 2)]
    stored = [k % 4 for r in rows for k in [r] * 4]
    frame = next(gif.decode(image([(0, None, 0, 0, 4, 16, 0x40, b"", stored)], (4, 16))))
    assert frame.indices[:, 0].tolist() == [r % 4 for r in range(16)]


def test_damaged_files():
    good = gif.encode(b"abc" * 500)
    for bad in (b"", b"GIF89a", good[:-1], good[:900], good[:20], b"PNG" + good):
        with pytest.raises((gif.GifError, IndexError, struct.error, ValueError)):
            list(gif.decode(bad))


def test_frames_table(spark):
    rows = [(1, gif.encode(b"x" * 1500)), (2, None), (3, b"junk"), (None, gif.encode(b"")), (1, gif.encode(b"x" * 1500)), (5, gif.encode(random.Random(5).randbytes(3000))[:3000])]
    media = spark.createDataFrame([(k, m, "c") for k, m in rows], "doc_id long, media binary, error string")
    found = gif.frames_table(media, "doc_id").collect()
    assert sum(r.doc_id == 1 for r in found) == 4 and not any(r.doc_id == 2 for r in found) and [r.error is not None for r in found if r.doc_id == 3] == [True]
    assert [r["index"] for r in found if r.doc_id is None] == [0] and [r.start_ms for r in found if r.doc_id == 1][:2] == [0, 40]
    assert sum(next(r.histogram for r in found if r.doc_id == 1)) == 1152 and [r.error for r in found if r.doc_id == 5][-1]
    assert gif.frames_table(media.limit(0), "doc_id").count() == 0


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "é\U0001f600", 5), (3, "é\U0001f600", 5), (4, "z" * 3_000_000, 5)], "doc_id long, text string, media int")
    found = {r.doc_id: r.media for r in gif.with_media(docs).collect()}
    assert found[1] == found[2] == gif.encode(b"") and gif.read_back(found[3])[0][:6] == "é\U0001f600".encode()
    assert np.frombuffer(gif.read_back(found[4])[0], np.uint8)[:3_000_000].tobytes() == b"z" * 3_000_000
    assert gif.with_media(docs.limit(0)).count() == 0
