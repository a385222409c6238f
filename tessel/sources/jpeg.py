"""Baseline and extended sequential JPEG with Huffman codes, 8 bits a sample.

Components come out as they are coded, interleaved and at full size (smaller ones are
repeated); no colour is converted, as a TIFF says itself what its components mean.
"""

from __future__ import annotations

import numpy as np

from tessel.errors import RasterError

# The order of coefficients, by row and column along diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_k = np.arange(8)
#: Rows are cosines, so that samples are COSINE.T @ coefficients @ COSINE.
COSINE = np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def spliced(data: bytes, tables: bytes | None) -> bytes:
    """An abbreviated stream with the tables that stand in a stream of their own."""
    return tables[:-2] + data[2:] if tables else data


class Bits:
    """Bits of a scan; stuffed zeros are gone, and restarts begin anew."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.held = (self.held << 8) | byte
            self.count += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.count -= n
        out = self.held >> self.count
        self.held &= (1 << self.count) - 1
        return out

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.need(16)
        size, value = table[(self.held >> (self.count - 16)) & 0xFFFF]
        if not size:
            raise RasterError("corrupt JPEG data")
        self.count -= size
        self.held &= (1 << self.count) - 1
        return value


def lookup(counts: bytes, values: bytes) -> list[tuple[int, int]]:
    """Size and value by the next 16 bits."""
    out: list[tuple[int, int]] = []
    at = 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            out += [(size, values[at])] * (1 << (16 - size))
            at += 1
    return (out + [(0, 0)] * 65536)[:65536]


def extended(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def decode(data: bytes) -> bytes:
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, list[tuple[int, int]]] = {}
    frame: list[dict] = []
    width = height = restart = 0
    planes: dict[int, np.ndarray] = {}
    at = 2
    if data[:2] != b"\xff\xd8":
        raise RasterError("not a JPEG stream")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xFF, 0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                table = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
                quant[n] = np.zeros(64)
                quant[n][ZIGZAG] = table
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                codes[body[0]] = lookup(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise RasterError("JPEG samples need 8 bits")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise RasterError("only sequential JPEG with Huffman codes is decoded")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = [next(c for c in frame if c["id"] == body[1 + 2 * i]) | {"dc": codes[body[2 + 2 * i] >> 4], "ac": codes[16 | body[2 + 2 * i] & 15]} for i in range(body[0])]
            stop = at
            while stop + 1 < len(data) and not (data[stop] == 0xFF and data[stop + 1] != 0 and not 0xD0 <= data[stop + 1] <= 0xD7):
                stop += 1
            scan(data[at:stop], chosen, frame, width, height, restart, quant, planes)
            at = stop
    if not frame or len(planes) < len(frame):
        raise RasterError("the JPEG stream has no image")
    return np.stack([planes[c["id"]] for c in frame], -1).tobytes()


def scan(data: bytes, chosen: list[dict], frame: list[dict], width: int, height: int, restart: int, quant: dict[int, np.ndarray], planes: dict[int, np.ndarray]) -> None:
    parts, begin = [], 0
    for i in range(len(data) - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            parts.append(data[begin:i])
            begin = i + 2
    parts.append(data[begin:])
    streams = iter(Bits(p.replace(b"\xff\x00", b"\xff")) for p in parts)
    most_h, most_v = max(c["h"] for c in frame), max(c["v"] for c in frame)
    alone = len(chosen) == 1
    for c in chosen:
        c["wide"], c["high"] = -(-width * c["h"] // most_h), -(-height * c["v"] // most_v)
        units = (-(-c["wide"] // 8), -(-c["high"] // 8)) if alone else (-(-width // (8 * most_h)) * c["h"], -(-height // (8 * most_v)) * c["v"])
        c["across"], c["blocks"] = units[0], np.zeros((units[1] * units[0], 64))
        c["last"] = 0
    across = chosen[0]["across"] if alone else -(-width // (8 * most_h))
    down = len(chosen[0]["blocks"]) // across if alone else -(-height // (8 * most_v))
    bits = next(streams)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            bits = next(streams)
            for c in chosen:
                c["last"] = 0
        y, x = divmod(unit, across)
        for c in chosen:
            for v in range(1 if alone else c["v"]):
                for h in range(1 if alone else c["h"]):
                    place = unit if alone else (y * c["v"] + v) * c["across"] + x * c["h"] + h
                    coefficients(bits, c, c["blocks"][place])
    for c in chosen:
        freq = (c["blocks"] * quant[c["q"]]).reshape(-1, 8, 8)
        pixels = np.clip(np.rint(COSINE.T @ freq @ COSINE + 128), 0, 255).astype(np.uint8)
        plane = pixels.reshape(-1, c["across"], 8, 8).transpose(0, 2, 1, 3).reshape(-1, c["across"] * 8)[: c["high"], : c["wide"]]
        ys, xs = np.arange(height) * c["v"] // most_v, np.arange(width) * c["h"] // most_h
        planes[c["id"]] = plane[np.minimum(ys, len(plane) - 1)[:, None], np.minimum(xs, plane.shape[1] - 1)[None, :]]


def coefficients(bits: Bits, c: dict, out: np.ndarray) -> None:
    size = bits.symbol(c["dc"])
    c["last"] += extended(bits.take(size), size)
    out[0] = c["last"]
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(c["ac"]), 16)
        if not size:
            if run < 15:
                return
            k += 16
            continue
        k += run
        if k > 63:
            raise RasterError("corrupt JPEG data")
        out[ZIGZAG[k]] = extended(bits.take(size), size)
        k += 1
