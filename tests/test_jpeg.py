"""A small encoder makes streams; decoding them gives the samples back to within rounding."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from tessel.errors import RasterError
from tessel.operators.dataset import from_bytes
from tessel.sources.jpeg import COSINE, ZIGZAG, decode

#: Codes of one length each: 4 bits for sizes, 8 bits for runs and sizes.
DC = list(range(12))
AC = [0, 0xF0] + [16 * r + s for r in range(16) for s in range(1, 11)]


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def tables():
    quant = segment(0xDB, b"\0" + b"\1" * 64)
    dc = segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(DC))
    ac = segment(0xC4, b"\x10" + bytes([0] * 7 + [len(AC)] + [0] * 8) + bytes(AC))
    return quant + dc + ac


def number(v):
    size = int(abs(v)).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def coded(block, last):
    z = np.rint(COSINE @ (block - 128.0) @ COSINE.T).astype(int).ravel()[ZIGZAG]
    size, bits = number(int(z[0]) - last)
    out, run = [format(DC.index(size), "04b") + bits], 0
    end = max(np.flatnonzero(z).max(initial=0), 0)
    for v in z[1 : end + 1].tolist():
        if v == 0:
            run += 1
            continue
        while run > 15:
            out.append(format(AC.index(0xF0), "08b"))
            run -= 16
        size, bits = number(v)
        out.append(format(AC.index(16 * run + size), "08b") + bits)
        run = 0
    if end < 63:
        out.append(format(AC.index(0), "08b"))
    return "".join(out), int(z[0])


def encode(planes, factors, restart=0, with_tables=True):
    """planes: full-size components; factors: (h, v) of each."""
    height, width = planes[0].shape
    mh, mv = max(h for h, _ in factors), max(v for _, v in factors)
    rows, columns = -(-height // (8 * mv)), -(-width // (8 * mh))
    small = []
    for p, (h, v) in zip(planes, factors, strict=True):
        q = p[:: mv // v, :: mh // h]
        small.append(np.pad(q, ((0, rows * 8 * v - q.shape[0]), (0, columns * 8 * h - q.shape[1])), mode="edge").astype(float))
    scans, bits, last = [], [], [0] * len(planes)
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            scans.append("".join(bits))
            bits, last = [], [0] * len(planes)
        y, x = divmod(unit, columns)
        for i, (h, v) in enumerate(factors):
            for b in range(v):
                for a in range(h):
                    r, c = (y * v + b) * 8, (x * h + a) * 8
                    text, last[i] = coded(small[i][r : r + 8, c : c + 8], last[i])
                    bits.append(text)
    scans.append("".join(bits))
    body = b""
    for n, s in enumerate(scans):
        s += "1" * (-len(s) % 8)
        body += int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + n % 8]) if n + 1 < len(scans) else b"")
    n = len(planes)
    frame = segment(0xC0, b"\x08" + struct.pack(">HHB", height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    start = segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0")
    return b"\xff\xd8" + (tables() if with_tables else b"") + frame + (segment(0xDD, struct.pack(">H", restart)) if restart else b"") + start + body + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("shape", [(8, 8), (19, 37)])
def test_grey_and_three(shape, restart):
    r = np.random.default_rng(1)
    planes = [r.integers(0, 256, shape).astype(np.uint8) for _ in range(3)]
    for n in (1, 3):
        out = np.frombuffer(decode(encode(planes[:n], [(1, 1)] * n, restart)), np.uint8).reshape(*shape, n)
        assert np.abs(out.astype(int) - np.stack(planes[:n], -1)).max() <= 3


def test_smaller_components():
    y, x = np.mgrid[:33, :47]
    planes = [(y * 3 + x * 2).astype(np.uint8), (100 + y // 8).astype(np.uint8), (90 + x // 8).astype(np.uint8)]
    out = np.frombuffer(decode(encode(planes, [(2, 2), (1, 1), (1, 1)])), np.uint8).reshape(33, 47, 3)
    assert np.abs(out.astype(int) - np.stack(planes, -1)).max() <= 3


def test_tables_of_the_file():
    """A strip without tables; they stand in the file's JPEGTables."""
    grey = (np.arange(16 * 24).reshape(16, 24) % 200).astype(np.uint8)
    strip, own = encode([grey], [(1, 1)], with_tables=False), b"\xff\xd8" + tables() + b"\xff\xd9"
    entries = [(256, 3, [24]), (257, 3, [16]), (258, 3, [8]), (259, 3, [7]), (262, 3, [1]), (273, 4, [0]), (277, 3, [1]), (278, 3, [16]), (279, 4, [len(strip)]), (347, 7, own)]
    begin = 8 + 2 + 12 * len(entries) + 4
    out = b""
    for tag, kind, value in entries:
        data = value if isinstance(value, bytes) else struct.pack("<H" if kind == 3 else "<I", begin + len(own) if tag == 273 else value[0])
        out += struct.pack("<HHI", tag, kind, len(value)) + (struct.pack("<I", begin) if len(data) > 4 else data.ljust(4, b"\0"))
    raw = b"II\x2a\0\x08\0\0\0" + struct.pack("<H", len(entries)) + out + b"\0" * 4 + own + strip
    (band,) = from_bytes(raw).image(0).read_rasters()
    assert np.abs(band.astype(int) - grey).max() <= 3


def test_what_is_not_decoded():
    with pytest.raises(RasterError, match="not a JPEG"):
        decode(b"xx")
    with pytest.raises(RasterError, match="no image"):
        decode(b"\xff\xd8\xff\xd9")
    with pytest.raises(RasterError, match="sequential"):
        decode(b"\xff\xd8" + segment(0xC2, b"\x08" + bytes(10)))
