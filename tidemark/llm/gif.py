"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames.

``frames`` decodes a column of GIF files into rows: one per frame as it is shown, after
disposal of the frame before and with transparent pixels left alone, with its delay, its
RGBA pixels and its colour histogram. ``encode`` writes 8-bit samples as a GIF and is the
exact inverse as far as samples go.

Codes are unpacked many at a time: after a clear code the width of every following code
is known from its position alone, so only the table lookups go one by one.

Defined results: a null or damaged file gives no frame rows and an ``error`` row from
``frames``; a null text counts as empty and makes 64 zero bytes; repeated rows each get
their own results; an empty table gives none; extra columns are left out. A long payload
becomes more frames, never a longer one, and none of it is dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import store

WIDTH = 64
ROWS = 1024
BINS = 16
FULL = 4096
DELAY = 10
#: A file that says it is larger counts as damaged: so many pixels are a quarter of a GB.
PIXELS = 1 << 26

_GRAY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def _widths(size: int, count: int) -> np.ndarray:
    """Bits of the codes that follow a clear code, first to last."""
    entries = (1 << size) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)


#: Codes until the table is full, the clear code that follows, and one to spare.
SEGMENT = {size: FULL - (1 << size) - 2 + 2 for size in range(1, 9)}


def _layout(size: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ``count`` codes after a clear code: widths, first bits, ends, and what each bit is worth."""
    widths = _widths(size, count)
    ends = np.cumsum(widths)
    starts = ends - widths
    return widths, starts, ends, (1 << (np.arange(ends[-1]) - np.repeat(starts, widths))).astype(np.int32)


_LAYOUTS = {size: _layout(size, SEGMENT[size]) for size in SEGMENT}


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw(data: bytes) -> bytes:
    """The code stream of 8-bit samples: greedy longest matches, cleared when the table is full."""
    clear, end = 256, 257
    codes: list[int] = [clear]
    starts = [1]  # where segments begin in codes
    table: dict[int, int] = {}
    free = end + 1
    samples = iter(data)
    run = next(samples)
    known = table.get
    for b in samples:
        key = run << 8 | b
        longer = known(key)
        if longer is not None:
            run = longer
            continue
        codes.append(run)
        run = b
        if free < FULL:
            table[key] = free
            free += 1
        else:
            codes.append(clear)
            starts.append(len(codes))
            table.clear()
            free = end + 1
    codes += (run, end)
    widths = np.full(len(codes), 9, np.int64)
    for s, t in zip(starts, [*starts[1:], len(codes)], strict=True):
        widths[s:t] = _LAYOUTS[8][0][: t - s]
    return _packed(np.array(codes, np.int64), widths)


def unlzw(stream: bytes, size: int, count: int) -> bytes:
    """``count`` samples of a code stream with ``size`` bits in a sample."""
    clear, end = 1 << size, (1 << size) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    out: list[bytes] = []
    at, ended, held, done = 0, False, 0, 0
    while not ended and at < len(bits) and held < count:
        _, starts, ends, worth = _LAYOUTS[size]
        while True:
            n = int(np.searchsorted(ends, len(bits) - at, side="right"))
            if not n:
                return _cut(out, count)
            codes = np.add.reduceat(bits[at : at + ends[n - 1]] * worth[: ends[n - 1]], starts[:n])
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or n < len(ends):
                break
            _, starts, ends, worth = _layout(size, 2 * len(ends))  # the table stays full for longer
        last = int(stop[0]) if len(stop) else n
        ended = not len(stop) or codes[last] == end
        at += int(ends[min(last, n - 1)])
        table = base[:]
        add, keep = table.append, out.append
        numbers = codes[:last].tolist()
        if numbers:
            before = base[numbers[0]] if numbers[0] < clear else _outside()
            keep(before)
        for c in numbers[1 : FULL - end]:
            try:
                found = table[c]
            except IndexError:
                found = before + before[:1] if c == len(table) else _outside()
            add(before + found[:1])
            keep(found)
            before = found
        out += [table[c] if c < FULL else _outside() for c in numbers[FULL - end :]]
        held += sum(map(len, out[done:]))
        done = len(out)
    return _cut(out, count)


def _outside() -> bytes:
    raise ValueError("code outside the table")


def _cut(out: list[bytes], count: int) -> bytes:
    data = b"".join(out)
    if len(data) < count:
        raise ValueError("code stream ends early")
    return data[:count]


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """``samples`` (a positive multiple of ``width``) as an animation: frames of up to
    ``rows`` lines, sample values as indices into a grey palette."""
    lines = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(lines, rows), 0xF7, 0, 0), _GRAY]
    for top in range(0, lines, rows):
        part = samples[top * width : (top + rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        stream = lzw(part)
        for i in range(0, len(stream), 255):
            block = stream[i : i + 255]
            out += (bytes([len(block)]), block)
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    """A frame as stored: its place, samples and palette; and ``shown``: the whole canvas."""

    left: int
    top: int
    delay_ms: int
    samples: np.ndarray
    shown: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF file, composed in order."""
    return list(decoded(data))


def decoded(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF file one after another, so that only one canvas is held (and a
    second one where a frame is to be taken back)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > PIXELS:
        raise ValueError("canvas too large")
    at = 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear = 0, 0, -1
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9:
                packed, wait, index = struct.unpack_from("<BHB", block)
                disposal, delay, clear = packed >> 2 & 7, 10 * wait, index if packed & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("no palette")
        size = data[at]
        if not 1 <= size <= 8:
            raise ValueError("code size out of range")
        if w * h > PIXELS:
            raise ValueError("frame too large")
        stream, at = _blocks(data, at + 1)
        samples = np.frombuffer(unlzw(stream, size, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:  # interlaced: every 8th line from 0, every 8th from 4, every 4th from 2, every 2nd from 1
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            lines = np.empty_like(samples)
            lines[order] = samples
            samples = lines
        if len(palette) < 256 and samples.size and int(samples.max()) >= len(palette):
            raise ValueError("sample outside the palette")
        saved = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]
        if clear < 0:
            area[..., :3] = palette[seen]
            area[..., 3] = 255
        else:
            drawn = seen != clear
            area[drawn, :3] = palette[seen[drawn]]
            area[drawn, 3] = 255
        yield Frame(left, top, delay, samples, canvas.copy())
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = saved
        disposal, delay, clear = 0, 0, -1


def damage(data: bytes) -> str | None:
    """What keeps a file from being decoded to its end, if anything does."""
    try:
        for _ in decoded(data):
            pass
    except (ValueError, LookupError, struct.error) as error:
        return f"{type(error).__name__}: {error}"
    return None


def histogram(shown: np.ndarray) -> np.ndarray:
    """Counts of visible pixels by red, green and blue, ``BINS`` bins each."""
    visible = shown if shown[..., 3].all() else shown[shown[..., 3] > 0]
    counts = [np.bincount(visible[..., c].ravel(), minlength=256) for c in range(3)]
    return np.concatenate([x.reshape(BINS, -1).sum(axis=1) for x in counts])


FRAMES = "id bigint, frame int, start_ms bigint, delay_ms bigint, width int, height int, rgba binary, histogram array<int>, error string"


def frames(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """Rows of ``FRAMES`` for a column of GIF files; a null or damaged file gives one row
    with only ``id`` and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FRAMES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.string()]
        def batched(*row: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for i, held in zip(batch.column(0), batch.column(1), strict=True):
                key, data, start = i.as_py(), held.as_py() or b"", 0
                if error := damage(data):
                    yield batched(key, *[None] * 7, error)
                    continue
                for n, f in enumerate(decoded(data)):
                    yield batched(key, n, start, f.delay_ms, f.shown.shape[1], f.shown.shape[0], f.shown.tobytes(), histogram(f.shown).tolist(), None)
                    start += f.delay_ms

    return media.select(id_column, media_column).mapInArrow(run, FRAMES)


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or 64 * (not data))


def text_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                part = [t.as_py() for t in texts[at : at + 256]]
                sizes = [len((t or "").encode()) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + 256], pa.array(sizes, pa.int64()), pa.array([encode(payload_of(t)) for t in part], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


FEATURES = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint,"
    " media_bytes bigint, media_sha256 string, feature string, n_frames bigint"
)


def text_features(documents: DataFrame) -> DataFrame:
    """Store every text as a GIF, read the files back and describe what they hold.

    ``feature``: the frames' colour histograms over their own lines, added up by grey level
    in ``BINS`` bins, then the length of the animation in ms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(",")]
        for batch in batches:
            rows = []
            for doc_id, n_bytes, media in zip(*batch.columns, strict=True):
                data = media.as_py()
                parts, counts, time, n = [], np.zeros(BINS, np.int64), 0, 0
                for f in decoded(data):
                    h, w = f.samples.shape
                    own = f.shown[f.top : f.top + h, f.left : f.left + w]
                    parts.append(own[..., 0].tobytes())
                    counts += histogram(own)[:BINS]
                    time, n = time + f.delay_ms, n + 1
                payload = b"".join(parts)
                feature = ",".join(map(str, counts)) + f";{time}"
                rows.append(
                    (doc_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, n)
                )
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    media = store(text_media(documents), "gif")
    return media.mapInArrow(run, FEATURES)
