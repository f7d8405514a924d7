"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms.

Defined results: null or empty bytes and broken files give one row with the
error and no frame data; frames before a break in the data are kept; repeated
rows are decoded each; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLEAR, STOP = 256, 257
#: Frames hold this many rows of WIDTH samples at most when bytes are stored as pictures.
WIDTH, ROWS = 64, 1024
FRAME_SCHEMA = "media_id long, frame int, start_ms long, delay_ms long, disposal int, x int, y int, width int, height int, transparent int, rgba binary, histogram array<long>, error string"


def _widths(root: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and the bits before each; root: bits of a literal."""
    first = (1 << root) + 2
    n = np.arange(0, 4096 * 4)
    # before code i (from 0) the decoder's table holds first + max(0, i - 1) entries
    held = np.minimum(first + np.maximum(0, n - 1), 4095)
    width = np.maximum(root + 1, np.floor(np.log2(held)).astype(np.int64) + 1)
    return width, np.r_[0, np.cumsum(width)]


_WIDTHS = {root: _widths(root) for root in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """Code stream of 8-bit samples; the table is cleared when it is full."""
    width, _ = _WIDTHS[8]
    codes, marks = [CLEAR], [0]
    add, table = codes.append, {}
    find = table.get
    free, cur = 258, -1
    for byte in data:
        if cur < 0:
            cur = byte
            continue
        key = cur << 8 | byte
        to = find(key)
        if to is not None:
            cur = to
            continue
        add(cur)
        table[key] = free
        free += 1
        cur = byte
        if free == 4096:
            marks.append(len(codes))
            add(CLEAR)
            table.clear()
            free = 258
    if cur >= 0:
        add(cur)
    add(STOP)
    number = np.array(codes, np.uint16)
    size = np.empty(len(codes), np.int64)
    size[0] = 9
    for a, b in zip(marks, [*marks[1:], len(codes) - 1], strict=True):
        size[a + 1 : b + 1] = width[: b - a]  # the codes after a clear code, the next clear or stop code included
    bits = np.unpackbits(number.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16)[None, :] < size[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, root: int, most: int) -> bytes:
    """Samples of a code stream, `most` at the most; a broken or short stream gives what came before the break."""
    width, before = _WIDTHS[root]
    clear, stop = 1 << root, (1 << root) + 1
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at = len(stream) * 8, 0
    out: list[bytes] = []
    made = 0
    while at + root + 1 <= total and made < most:
        n = min(len(width), int(np.searchsorted(before, total - at, "right")) - 1)
        off = at + before[:n]
        i = off >> 3
        codes = ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (off & 7).astype(np.uint32)) & ((1 << width[:n]) - 1).astype(np.uint32)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        end = int(ends[0]) if len(ends) else n
        part = codes[:end].tolist()
        ended = end == n or codes[end] == stop
        at += int(before[min(end + 1, n)])
        if part:
            table = literals.copy()
            grow = table.append
            if part[0] >= clear:
                break
            prev = table[part[0]]
            out.append(prev)
            put = out.append
            broken = False
            for c in part[1:]:
                if c < len(table):
                    entry = table[c]
                    if len(table) < 4096:
                        grow(prev + entry[:1])
                elif c == len(table) and c < 4096:
                    entry = prev + prev[:1]
                    grow(entry)
                else:
                    broken = True
                    break
                put(entry)
                prev = entry
            made = sum(map(len, out)) if len(out) < 8192 else made + sum(map(len, out[-len(part) :]))
            if broken:
                break
        if ended and (end < n or n < len(width)):
            break
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GRAY = bytes(v for i in range(256) for v in (i, i, i))


def encode(frames: list[bytes], width: int, delay_cs: int = 10, palette: bytes = GRAY) -> bytes:
    """A GIF of frames of 8-bit samples, each as wide as the canvas and kept when the next is drawn."""
    height = max(len(f) for f in frames) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(f) // width, 0) + b"\x08")
        out.append(_blocks(lzw_encode(f)))
    return b"".join([*out, b"\x3b"])


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of WIDTH, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def stored(data: bytes) -> bytes:
    """The payload as grey samples, WIDTH to a row and ROWS rows to a frame."""
    return encode([data[i : i + WIDTH * ROWS] for i in range(0, len(data), WIDTH * ROWS)], WIDTH)


@dataclass
class Frame:
    delay_ms: int
    disposal: int
    x: int
    y: int
    width: int
    height: int
    transparent: int
    index: np.ndarray
    colours: np.ndarray
    canvas: np.ndarray | None


class BrokenGif(ValueError):
    """The bytes are not a whole GIF."""


def _interlaced(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    order = [*range(0, n, 8), *range(4, n, 8), *range(2, n, 4), *range(1, n, 2)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode(data: bytes, composite: bool = True) -> Iterator[Frame]:
    """Frames in order, each with the canvas as it is shown (RGBA); raises BrokenGif at a break."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise BrokenGif("no GIF header")
    wide, high, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None

    def table(bits: int) -> np.ndarray:
        nonlocal at
        size = 3 << (bits & 7) + 1
        if at + size > len(data):
            raise BrokenGif("short palette")
        at += size
        return np.frombuffer(data, np.uint8, size, at - size).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        if at >= len(data):
            raise BrokenGif("short data")
        at += 1
        return b"".join(parts)

    if packed & 0x80:
        shared = table(packed)
    canvas = np.zeros((high, wide, 4), np.uint8) if composite else None
    delay, disposal, clear = 0, 0, -1
    while True:
        if at >= len(data):
            raise BrokenGif("no trailer")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                flags, cs, clear = struct.unpack_from("<BHB", body)
                delay, disposal, clear = cs * 10, flags >> 2 & 7, clear if flags & 1 else -1
            continue
        if kind != 0x2C or at + 9 > len(data):
            raise BrokenGif("unknown block")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = table(flags) if flags & 0x80 else shared
        root = data[at] if at < len(data) else 0
        at += 1
        if colours is None or not 2 <= root <= 8:
            raise BrokenGif("no palette" if colours is None else "code size")
        samples = lzw_decode(blocks(), root, w * h)
        if len(samples) < w * h:
            raise BrokenGif("short picture")
        index = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 0x40:
            index = _interlaced(index)
        if len(colours) < 256 and index.size and index.max() >= len(colours):
            raise BrokenGif("colour outside the palette")
        shown = None
        if composite:
            kept = canvas.copy() if disposal == 3 else None
            ry, rx = max(0, min(h, high - y)), max(0, min(w, wide - x))
            part, inner = canvas[y : y + ry, x : x + rx], index[:ry, :rx]
            solid = inner != clear
            part[..., :3] = np.where(solid[..., None], colours[inner], part[..., :3])
            part[..., 3] = np.where(solid, 255, part[..., 3])
            shown = canvas.copy()
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = kept
        yield Frame(delay, disposal, x, y, w, h, clear, index, colours, shown)
        delay, disposal, clear = 0, 0, -1


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Opaque pixels by the two high bits of red, green and blue: 64 counts."""
    p = rgba.reshape(-1, 4)
    p = p[p[:, 3] > 0] >> 6
    return np.bincount(p[:, 0].astype(np.int64) << 4 | p[:, 1].astype(np.int64) << 2 | p[:, 2], minlength=64)


def _frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FRAME_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.binary(), pa.list_(pa.int64()), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in batches:
        for media, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            start, n = 0, 0
            try:
                for f in decode(data.as_py() or b""):
                    yield batch([(media, n, start, f.delay_ms, f.disposal, f.x, f.y, f.width, f.height, f.transparent, f.canvas.tobytes(), histogram(f.canvas).tolist(), None)])
                    start, n = start + f.delay_ms, n + 1
            except BrokenGif as e:
                yield batch([(media, n, start, *[None] * 9, str(e))])


def decode_frames(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per shown frame; a broken file ends in a row with its error."""
    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(data_col).alias("data")).mapInArrow(_frame_rows, FRAME_SCHEMA)


def _gif_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            c = b.slice(at, 256)
            made = [(*payload(t.as_py()),) for t in c.column(1)]
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([stored(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "gif"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, gif): every whole text as a GIF of grey samples."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_gif_rows, "doc_id long, n_bytes long, gif binary")


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib
    import zlib

    for b in batches:
        rows = []
        for doc, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            data, size, tail, sha = data.as_py(), 0, b"", hashlib.sha256()
            counts, frames, shown = np.zeros(64, np.int64), 0, 0
            for f in decode(data):
                part = f.canvas[: f.height, :, 0].tobytes()  # what is read back passed through the palette
                sha.update(part)
                size, tail = size + len(part), part[-64:]
                counts += histogram(f.canvas[: f.height])
                frames, shown = frames + 1, shown + f.delay_ms
            gray = counts[[0, 21, 42, 63]]
            feature = f"frames={frames};ms={shown};gray=" + ",".join(map(str, gray.tolist()))
            rows.append((doc, n, size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in DIGEST_SCHEMA.split(", ")])


def read_back(stored_texts: DataFrame) -> DataFrame:
    """Digests and colour features of what the stored pictures give back."""
    return stored_texts.select("doc_id", "n_bytes", "gif").mapInArrow(_digests, DIGEST_SCHEMA)
