"""GIF media columns: storing bytes as frames of palette indices, and decoding GIF files.

The decoder handles whole GIF89a files: code streams of any LZW code size with deferred clears, global
and local palettes, interlacing, frame positions, transparency and the disposal methods. The encoder
writes 8-bit grey frames with LZW compression.

Code streams don't depend on each other, so many are coded or decoded side by side, a code of each at a
time, by array operations; a table entry of a decoder is the place in the output where its string first
stands. A stream alone goes through a plain loop.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import small_batches

SIDE = 24
#: Payloads are a multiple of UNIT bytes; a frame holds FRAME of them, a last one perhaps fewer.
UNIT, FRAME = SIDE * SIDE, 2 * SIDE * SIDE
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: Frames coded at once, and pixels at most (but for a single larger frame).
_BLOCK, _PIXELS = 2048, 1 << 22
#: Rows of an Arrow batch: so many that enough frames are coded side by side.
BATCH_ROWS = 1024
#: Fewer streams than these are decoded one by one.
_SIDE_BY_SIDE = 8


class GifError(ValueError):
    pass


def payload(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT or (UNIT if not data else 0))


def encode(data: bytes, delay: int = 4) -> bytes:
    """A GIF of frames of SIDE x 2 SIDE that holds ``payload(data)``, a byte per pixel; ``delay`` in 1/100 s."""
    return encode_many([data], delay)[0]


def encode_many(texts: list[bytes], delay: int = 4) -> list[bytes]:
    """``encode`` of each of ``texts``."""
    start, rest = b"GIF89a" + struct.pack("<HH", SIDE, FRAME // SIDE), b"\xf7\0\0" + _GREY + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0)
    held = [payload(t) for t in texts]
    whole, last = (_streams([d[a : a + n] for d in held for a in places(d)], n) for n, places in ((FRAME, lambda d: range(0, len(d) // FRAME * FRAME, FRAME)), (UNIT, lambda d: range(len(d) // FRAME * FRAME, len(d), UNIT))))
    out = []
    for data in held:
        parts = [start, rest]
        for at in range(0, len(data), FRAME):
            long = min(FRAME, len(data) - at)
            stream = next(whole if long == FRAME else last)
            parts += [control, b"\x2c", struct.pack("<HHHHB", 0, 0, SIDE, long // SIDE, 0), b"\x08"]
            for a in range(0, len(stream), 255):
                parts += [bytes([min(255, len(stream) - a)]), stream[a : a + 255]]
            parts.append(b"\0")
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def _streams(parts: list[bytes], long: int) -> Iterator[bytes]:
    """The code streams of parts of ``long`` bytes each, a block at a time."""
    for at in range(0, len(parts), _BLOCK):
        yield from lzw_encode_many(np.frombuffer(b"".join(parts[at : at + _BLOCK]), np.uint8).reshape(-1, long))


def _widths(codes: int, size: int = 8) -> np.ndarray:
    """Bits of the k-th code after a clear, for k up to ``codes``."""
    return np.clip(np.ceil(np.log2(np.arange(codes) + (1 << size) + 2)), size + 1, 12).astype(np.int64)


def lzw_encode_many(pixels: np.ndarray) -> list[bytes]:
    """The LZW code streams, for a code size of 8, of each row of bytes; rows so short that no table fills up."""
    n, m = pixels.shape
    if m > 2048 - 258:
        return [lzw_encode(row.tobytes(), 8) for row in pixels]
    mask = (1 << (3 * m).bit_length()) - 1  # an open hash table for each row: prefix, byte and their code in one number
    table, first, line = np.zeros(n * (mask + 1), np.int32), np.arange(n) * (mask + 1), np.arange(n) * m
    columns = np.ascontiguousarray(pixels.T).astype(np.int64)
    prefix, count, said = columns[0].copy(), np.zeros(n, np.int64), np.zeros(n * m, np.int16)
    for byte in columns[1:]:
        key = (prefix << 8 | byte) + 1
        slot = first + (key * 40503 >> 4 & mask)
        there = table.take(slot)
        missed = there >> 11 != key
        other = np.flatnonzero(missed & (there != 0))
        while len(other):
            moved = first[other] + (slot[other] + 1 & mask)
            slot[other], there[other] = moved, (now := table.take(moved))
            missed[other] = differ = now >> 11 != key[other]
            other = other[differ & (now != 0)]
        new = np.flatnonzero(missed)
        end = count[new]
        said[line[new] + end] = prefix[new]
        table[slot[new]] = key[new] << 11 | end + 258
        count[new] = end + 1
        prefix = np.where(missed, byte, there & 2047)
    said[line + count] = prefix
    said, rows, count = said.reshape(n, m), np.arange(n), count + 1
    # codes take 9 bits or more, so no two start in one byte
    widths = _widths(m + 1)
    starts = 9 + np.concatenate(([0], np.cumsum(widths)))
    long = (starts[count] + widths[count] + 7) // 8
    out = np.zeros((n, int(long.max()) + 3), np.uint8)
    out[:, 1] = 1  # the clear, 256
    row, k = np.nonzero(np.arange(m) < count[:, None])
    for row, value, bit in ((row, said[row, k].astype(np.int64), starts[k]), (rows, np.full(n, 257), starts[count])):
        value = value << (bit & 7)
        for byte in range(3):
            out[row, (bit >> 3) + byte] |= (value >> 8 * byte & 255).astype(np.uint8)
    return [o[:e].tobytes() for o, e in zip(out, long.tolist())]


def lzw_encode(data: bytes, size: int) -> bytes:
    """The LZW code stream of ``data``, whose bytes are under 2**size."""
    clear, end = 1 << size, (1 << size) + 1
    acc, held, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc |= code << held
        held += width
        while held >= 8:
            out.append(acc & 255)
            acc >>= 8
            held -= 8

    table, width, prefix = {bytes([k]): k for k in range(clear)}, size + 1, b""
    put(clear, width)
    for k in range(len(data)):
        longer = prefix + data[k : k + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        code = len(table) + 2
        if code < 4096:
            table[longer] = code
            width += code == 1 << width and width < 12
        else:
            put(clear, width)
            table, width = {bytes([j]): j for j in range(clear)}, size + 1
        prefix = data[k : k + 1]
    if prefix:
        put(table[prefix], width)
        width += len(table) + 2 == 1 << width and width < 12  # as a decoder adds an entry for it
    put(end, width)
    put(0, -held % 8)
    return bytes(out)


def lzw_decode_many(streams: list[bytes], sizes: list[int], pixels: list[int]) -> list[np.ndarray | GifError]:
    """``lzw_decode`` of each of ``streams``, or what it would raise."""
    if len(streams) < _SIDE_BY_SIDE:
        return [_or_error(*x) for x in zip(streams, sizes, pixels)]
    n, most = len(streams), np.array(pixels, np.int64)
    ends = np.array([8 * len(s) for s in streams])
    wide = int(ends.max()) // 8 + 3
    data = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in streams) + b"\0\0", np.uint8).astype(np.int64)
    data = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    room = min(int(most.max()), 4096) + 1
    begun, long = np.zeros(n * room, np.int64), np.zeros(n * room, np.int64)  # of each code since the clear: its place in the output, its length
    row, told, bad, total = np.arange(n), [], np.zeros(n, bool), np.zeros(n, np.int64)
    made, bit, since, clear = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), 1 << np.array(sizes, np.int64)
    left, low = most, np.array(sizes, np.int64) + 1
    while len(row):
        width = np.minimum(np.maximum(_BITS.take(np.minimum(since + clear + 1, 4095)), low), 12)
        code = data.take(row * wide + (bit >> 3)) >> (bit & 7) & (1 << width) - 1
        bit = bit + width
        entry = code - clear - 2  # of the code that first made it
        literal = entry < -2
        wrong = (bit > ends[row]) | (entry >= np.minimum(since, 4094 - clear))
        halt = wrong | (entry == -2) | (entry == -1)
        some = bool(halt.any())
        places = row * room + np.maximum(entry, 0)
        length = np.where(literal, 1, long.take(places) + 1)
        source = np.where(literal, -1 - code, begun.take(places))
        places = row * room + np.minimum(since, room - 1)
        if some:
            go = ~halt
            bad[row[wrong]] = True
            begun[places[go]], long[places[go]] = made[go], length[go]
            told.append((row[go], made[go], np.minimum(length, left - made)[go], source[go]))
            made = np.where(go, made + length, made)
            since = np.where(go, since + 1, 0)
        else:
            begun[places], long[places] = made, length
            told.append((row, made, np.minimum(length, left - made), source))
            made, since = made + length, since + 1
        on = (made < left) & ~(wrong | (entry == -1)) if some else made < left
        if not on.all():
            total[row] = made
            row, bit, since, made, clear, left, low = (x[on] for x in (row, bit, since, made, clear, left, low))
    made = total
    bases = np.concatenate(([0], np.cumsum(most)))
    r, at, length, source = (np.concatenate([t[k] for t in told]) if told else np.zeros(0, np.int64) for k in range(4))
    # a byte of the output is a literal or points to an earlier byte
    points = np.zeros(bases[-1], np.int64)
    spans = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    places = np.repeat(bases[r] + at, length) + spans
    values = np.zeros(bases[-1], np.uint8)
    values[(bases[r] + at)[source < 0]] = -1 - source[source < 0]
    points[places] = np.where(np.repeat(source < 0, length), places, np.repeat(bases[r] + source, length) + spans)
    while (further := points[points]).any() and (further != points).any():
        points = further
    out = values[points]
    short = bad | (made < most)
    return [GifError("the code stream ends early or has a code that isn't in the table") if s else out[a:b] for s, a, b in zip(short.tolist(), bases[:-1].tolist(), bases[1:].tolist())]


#: Bits of a number up to 4095.
_BITS = np.array([k.bit_length() for k in range(4096)])


def _or_error(stream: bytes, size: int, pixels: int) -> np.ndarray | GifError:
    try:
        return lzw_decode(stream, size, pixels)
    except GifError as e:
        return e


def lzw_decode(stream: bytes, size: int, pixels: int) -> np.ndarray:
    """Palette indices of a code stream; more than ``pixels`` are cut, fewer raise."""
    clear, end = 1 << size, (1 << size) + 1
    acc, held, at, width, previous = 0, 0, 0, size + 1, b""
    table: list[bytes] = [bytes([k]) for k in range(clear)] + [b"", b""]
    out, made = [], 0
    while made < pixels:
        while held < width:
            if at >= len(stream):
                raise GifError("the code stream ends early")
            acc |= stream[at] << held
            at, held = at + 1, held + 8
        code, acc, held = acc & (1 << width) - 1, acc >> width, held - width
        if code == clear:
            del table[clear + 2 :]
            width, previous = size + 1, b""
            continue
        if code == end:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise GifError("a code that isn't in the table")
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out.append(entry)
        made += len(entry)
        previous = entry
    if made < pixels:
        raise GifError("too few pixels")
    return np.frombuffer(b"".join(out), np.uint8)[:pixels]


@dataclass
class Frame:
    index: int
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int | None
    box: tuple[int, int, int, int]  # left, top, width, height
    indices: np.ndarray  # (height, width), as stored
    rgb: np.ndarray  # (canvas height, canvas width, 3), as shown
    shown: np.ndarray  # (canvas height, canvas width): False where the canvas is clear


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("the file ends within a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


@dataclass
class Image:
    """An image block as it is in the file; ``screen`` is the canvas (height, width)."""

    screen: tuple[int, int]
    control: tuple[int, int, int | None]  # disposal, delay in 1/100 s, transparent index
    box: tuple[int, int, int, int]
    interlaced: bool
    colours: np.ndarray
    size: int
    stream: bytes


def images(data: bytes) -> Iterator[Image]:
    """The image blocks of a GIF file."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("not a GIF file")
    wide, high, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    control = (0, 0, None)
    while True:
        if at >= len(data):
            raise GifError("no trailer")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            block, following = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(block) >= 4:
                control = (block[0] >> 2 & 7, block[1] | block[2] << 8, block[3] if block[0] & 1 else None)
            at = following
            continue
        if kind != 0x2C:
            raise GifError(f"unknown block {kind}")
        left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, colours = at + 10, palette
        if own & 0x80:
            n = 3 << (own & 7) + 1
            colours, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
        if colours is None:
            raise GifError("no palette")
        size = data[at]
        if not 2 <= size <= 8:
            raise GifError(f"code size {size}")
        stream, at = _blocks(data, at + 1)
        yield Image((high, wide), control, (left, top, w, h), bool(own & 0x40), colours, size, stream)
        control = (0, 0, None)


def _indexed(found: Iterable[tuple[int, Image | GifError]]) -> Iterator[tuple[int, Image | GifError, np.ndarray | GifError]]:
    """With the decoded stream of each image, a block of images at a time; errors pass."""
    block, pixels = [], 0

    def decoded():
        own = [i for _, i in block if isinstance(i, Image)]
        told = iter(lzw_decode_many([i.stream for i in own], [i.size for i in own], [i.box[2] * i.box[3] for i in own]))
        return ((f, i, next(told) if isinstance(i, Image) else i) for f, i in block)

    for f, i in found:
        n = i.box[2] * i.box[3] if isinstance(i, Image) else 0
        if block and (len(block) == _BLOCK or pixels + n > _PIXELS):
            yield from decoded()
            block, pixels = [], 0
        block.append((f, i))
        pixels += n
    yield from decoded()


def decode_many(files: list[bytes]) -> Iterator[tuple[int, Frame | GifError]]:
    """(number of the file, frame) of all frames of GIF files, as shown after palette, transparency and disposal.

    A damaged file gives its frames up to the damage, then the error.
    """

    def parsed():
        for f, data in enumerate(files):
            try:
                yield from ((f, i) for i in images(data))
            except (GifError, IndexError, struct.error, ValueError) as e:
                yield f, GifError(str(e) or "damaged")

    here, rgb, shown, clock, count = -1, None, None, 0, 0
    dead = -1
    for f, image, indices in _indexed(parsed()):
        if f == dead:
            continue
        if isinstance(indices, GifError):
            dead = f
            yield f, indices
            continue
        if f != here:
            here, clock, count = f, 0, 0
            rgb, shown = np.zeros((*image.screen, 3), np.uint8), np.zeros(image.screen, bool)
        (high, wide), (left, top, w, h) = image.screen, image.box
        indices = indices.reshape(h, w)
        if image.interlaced:
            rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(indices)
            straight[rows] = indices
            indices = straight
        disposal, delay, clear = image.control
        before = (rgb.copy(), shown.copy()) if disposal == 3 else None
        fits = (slice(top, min(top + h, high)), slice(left, min(left + w, wide)))
        part = indices[: max(0, high - top), : max(0, wide - left)]
        if clear is None and len(image.colours) == 256:
            rgb[fits], shown[fits] = image.colours[part], True
        else:
            paint = part < len(image.colours) if clear is None else (part != clear) & (part < len(image.colours))
            rgb[fits][paint] = image.colours[part[paint]]
            shown[fits] |= paint
        yield f, Frame(count, clock * 10, delay * 10, disposal, clear, image.box, indices, rgb.copy(), shown.copy())
        if disposal == 2:
            rgb[fits], shown[fits] = 0, False
        elif disposal == 3:
            rgb, shown = before
        clock, count = clock + delay, count + 1


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF file; damage raises."""
    for _, frame in decode_many([data]):
        if isinstance(frame, GifError):
            raise frame
        yield frame


def histogram(frame: Frame) -> list[int]:
    """Counts of shown pixels by colour: 2 bits of red, green and blue each (64 bins)."""
    c = frame.rgb[frame.shown] >> 6
    return np.bincount(c @ _BINS, minlength=64).tolist()


_BINS = np.array([16, 4, 1], np.uint8)
FRAMES = "index int, start_ms long, delay_ms long, disposal int, transparent int, left int, top int, width int, height int, histogram array<int>, rgb binary, error string"


def frames_table(media: DataFrame, key: str, column: str = "media", keep_pixels: bool = True) -> DataFrame:
    """A row per timed frame of each GIF: ``key``, the columns of FRAMES.

    Null media give no row; a file that can't be decoded gives its good frames and then a row with
    ``error`` set (all else null). Other columns of ``media`` are ignored.
    """
    spec = [(x.split()[0], x.split()[1]) for x in FRAMES.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def rows(data: bytes):
        for _, f in decode_many([data]):
            if isinstance(f, GifError):
                yield (*[None] * 11, str(f))
            else:
                yield (f.index, f.start_ms, f.delay_ms, f.disposal, f.transparent, *f.box, histogram(f), f.rgb.tobytes() if keep_pixels else None, None)

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                held, source = [], rows(data) if data is not None else iter(())
                done = False
                while not done:
                    held = [r for _, r in zip(range(_BLOCK), source)]
                    done = len(held) < _BLOCK
                    if held:
                        keys = batch.column(0).slice(i, 1).take(pa.array([0] * len(held)))
                        yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*held), spec))], [key, *(n for n, _ in spec)])

    small_batches(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, {FRAMES}")


def with_media(docs: DataFrame, delay: int = 4, name: str = "media") -> DataFrame:
    """``docs`` with its column ``text`` (null: empty) stored losslessly as GIF bytes in column ``name`` (replaced if there)."""
    small_batches(docs.sparkSession, BATCH_ROWS)

    @F.arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        return pa.array(encode_many([(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()], delay), pa.binary())

    return docs.withColumn(name, stored("text"))


def read_back(data: bytes) -> tuple[bytes, list[int], int]:
    """(bytes held by the frames' indices, their summed colour histogram, duration in ms)."""
    return read_back_many([data])[0]


def read_back_many(files: list[bytes]) -> list[tuple[bytes, list[int], int]]:
    """``read_back`` of each of ``files``."""
    parts, totals, ends = [[] for _ in files], np.zeros((len(files), 64), np.int64), [0] * len(files)
    for f, frame in decode_many(files):
        if isinstance(frame, GifError):
            raise frame
        parts[f].append(frame.indices.tobytes())
        totals[f] += histogram(frame)
        ends[f] = frame.start_ms + frame.delay_ms
    return [(b"".join(p), t.tolist(), e) for p, t, e in zip(parts, totals, ends)]
