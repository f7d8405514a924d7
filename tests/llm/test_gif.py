import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest

from sieveglass.llm import gif as G


def slow_decode(stream, root):
    """LZW bit by bit, as the format describes it."""
    bits = int.from_bytes(stream, "little")
    at, size, out, table, prev = 0, root + 1, b"", None, None
    while True:
        c = bits >> at & ((1 << size) - 1)
        at += size
        if c == 1 << root:
            table, size, prev = [bytes([i]) for i in range(1 << root)] + [b"", b""], root + 1, None
            continue
        if c == (1 << root) + 1:
            return out
        if prev is None:
            entry = table[c]
        else:
            entry = table[c] if c < len(table) else prev + prev[:1]
            if len(table) < 4096:
                table.append(prev + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
        out, prev = out + entry, entry


@pytest.mark.parametrize("n", [0, 1, 2, 254, 255, 256, 257, 3000, 5000, 70000])
@pytest.mark.parametrize("kind", ["same", "random", "text"])
def test_round_trip(n, kind):
    rng = random.Random(n)
    data = {"same": b"a" * n, "random": rng.randbytes(n), "text": (b"the quick brown fox " * (n // 20 + 1))[:n]}[kind]
    stream = G.lzw_encode(data)
    assert G.lzw_decode(stream, 8, n + 10) == data
    if n <= 5000:
        assert slow_decode(stream, 8) == data
    for cut in (len(stream) // 2, 1):
        assert data.startswith(G.lzw_decode(stream[:cut], 8, n))


def test_full_table_without_clear_is_kept():
    codes, width, data = [256], [9], random.Random(1).randbytes(6000)
    w, _ = G._WIDTHS[8]
    codes += [*data, 257]
    width += w[: len(data) + 1].tolist()
    bits = "".join(format(c, f"0{k}b")[::-1] for c, k in zip(codes, width))
    stream = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    assert G.lzw_decode(stream, 8, 6000) == data == slow_decode(stream, 8)


def one(index, pal, x=0, y=0, w=2, h=1, delay=5, disposal=0, clear=None, interlace=False):
    n = max(2, (len(pal) // 3 - 1).bit_length())
    codes = [1 << n, *index, (1 << n) + 1]
    width, _ = G._WIDTHS[n]
    widths = [n + 1, *width[: len(index) + 1].tolist()]
    bits = "".join(format(c, f"0{k}b")[::-1] for c, k in zip(codes, widths))
    data = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    flags = 0x80 | (len(pal) // 3).bit_length() - 2 | (0x40 if interlace else 0)
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0) + struct.pack("<BHHHHB", 0x2C, x, y, w, h, flags) + pal + bytes([n]) + G._blocks(data)


RGB = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])


def test_disposal_and_transparency():
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0, 0, 0)
    data = head + one([0, 1], RGB, disposal=1) + one([2, 3], RGB, clear=3, disposal=3) + one([3, 2], RGB, clear=3, disposal=2) + one([1], RGB, w=1) + b";"
    got = [f.canvas[0, :, :].tolist() for f in G.decode(data)]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert got == [[red, green], [blue, green], [red, blue], [green, none]]


def test_interlace():
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 9, 0, 0, 0)
    rows = [0, 1, 2, 3, 0, 1, 2, 3, 0]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    (f,) = G.decode(head + one([rows[i] for i in order], RGB, w=1, h=9, interlace=True) + b";")
    assert f.index[:, 0].tolist() == rows


def test_query_digests(spark):
    texts = [None, "", "x", "Zoë ✓ " * 11, "a" * 64, "long " * 40000, "x"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, gif int")
    got = {r.doc_id: r for r in G.read_back(G.store_texts(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[2].feature == got[6].feature and got[2].media_sha256 == got[6].media_sha256
    assert got[5].feature.startswith("frames=4;ms=400;")


def test_frames_and_broken_files(spark):
    good = G.stored(b"ab" * 64)
    df = spark.createDataFrame([(1, good), (2, good[:-20]), (3, b""), (4, None), (5, b"GIF89a")], "media_id long, data binary")
    got = {(r.media_id, r.frame): r for r in G.decode_frames(df, "media_id", "data").collect()}
    assert got[1, 0].error is None and sum(got[1, 0].histogram) == 128 and got[1, 0].delay_ms == 100
    assert np.frombuffer(bytes(got[1, 0].rgba), np.uint8).reshape(-1, 4)[:, 0].tobytes() == b"ab" * 64
    assert all(got[i, 0].error for i in (2, 3, 4, 5))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert G.read_back(G.store_texts(docs)).count() == 0
    assert G.decode_frames(spark.createDataFrame([], "media_id long, data binary"), "media_id", "data").count() == 0
