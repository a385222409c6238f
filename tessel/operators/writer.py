"""TIFF files from arrays: classic, big-endian, one image, uncompressed, pixels from byte 1000 on."""

from __future__ import annotations

import math
import struct

import numpy as np

from tessel.errors import RasterError
from tessel.functions.dictionary import resolve_tag, writer_type

RESERVED = 1000
SIZES = {"ASCII": 1, "SHORT": 2, "LONG": 4, "RATIONAL": 8, "DOUBLE": 8}
TYPE_IDS = {"ASCII": 2, "SHORT": 3, "LONG": 4, "RATIONAL": 5, "DOUBLE": 12}
FORMATS = {"u": 1, "i": 2, "f": 3}


class WriterError(RasterError):
    pass


def write(data, tags: dict | None = None, geo_keys: dict[int, object] | None = None, width: int | None = None, height: int | None = None, lossless: bool = True) -> bytes:
    """The bytes of a file.

    data: a numpy array (flat, pixel by pixel), nested lists [band][row][column], or a flat
    list of numbers (the last two are stored as bytes). tags: by id or name. Of tags not
    given: no compression, samples by pixel, WGS 84 over the whole world. lossless=False
    stores integers with a sign by their low byte only, as some readers' tests expect.
    """
    tags = {resolve_tag(k): v if isinstance(v, str) else list(np.atleast_1d(v)) for k, v in (tags or {}).items()}
    keys = dict(geo_keys or {})
    nested = isinstance(data, list) and bool(data) and isinstance(data[0], (list, np.ndarray))
    if nested:
        if not len(data[0]) or not len(data[0][0]):
            raise WriterError("the data is empty")
        cube = np.array([[list(row) for row in band] for band in data], np.float64)
        height, width = cube.shape[1:]
        samples = int(tags.get(277, [len(data)])[0])
        if samples != len(data):
            raise WriterError(f"SamplesPerPixel is {samples}, but {len(data)} bands were supplied")
        planar = cube if tags.get(284, [1])[0] == 2 else cube.transpose(1, 2, 0)
        data = planar.ravel().tolist()
    typed = isinstance(data, np.ndarray)
    count = data.size if typed else len(data)
    if not count:
        raise WriterError("the data is empty")
    height = height or int(tags.get(257, [0])[0])
    width = width or int(tags.get(256, [0])[0])
    if not height:
        raise WriterError("the image's height is missing")
    if not width:
        raise WriterError("the image's width is missing")
    if not nested:
        if 277 in tags:
            samples = int(tags[277][0])
        elif count % (width * height):
            raise WriterError("the data does not fit the dimensions")
        else:
            samples = count // (width * height)
        if not samples or count < width * height * samples:
            raise WriterError("the data does not fit the dimensions")
    tiled = 325 in tags
    if tiled and 277 not in tags:
        raise WriterError("tiled images need SamplesPerPixel")
    if tiled and (322 not in tags or 323 not in tags):
        raise WriterError("tiled images need TileWidth and TileLength")
    size, bits, kind = (data.dtype.itemsize, data.dtype.itemsize * 8, FORMATS[data.dtype.kind]) if typed else (8, 8, 1)
    tags |= {256: [width], 257: [height]}
    for tag, value in ((258, [bits] * samples), (259, [1]), (284, [1]), (338, []), (339, [kind] * samples), (277, [samples])):
        tags.setdefault(tag, value)
    if not tags.get(262) or not tags[262][0]:
        tags[262] = [2 if len(tags[258]) == 3 else 1]
    if not tiled:
        rows = int(tags[278][0]) if tags.get(278) else height
        tags.setdefault(279, [samples * size * width * min(rows, height - y) for y in range(0, height, max(1, rows))])
    if 33550 not in tags and 34264 not in tags:
        tags[33550] = [360 / width, 180 / height, 0]
    if 2048 not in keys and 3072 not in keys:
        keys |= {2048: 4326, 2049: "WGS 84", 1024: 2}
        if 34264 not in tags:
            tags[33922] = [0, 0, 0, -180, 90, 0]
    directory_of_keys(tags, keys)
    tags.pop(273, None)
    places = offsets([int(n) for n in tags[325 if tiled else 279]])
    # what the caller gave stands over these
    tags = {305: "tessel", **({324: places} if tiled else {273: places, 278: [height]}), **tags}
    head = directory(tags)
    body = payload(data, lossless)
    each = 1 if typed and not lossless and data.dtype.kind == "i" else size
    out = bytearray(RESERVED + count * each)
    out[: len(head)] = head
    out[RESERVED : RESERVED + len(body)] = body
    return bytes(out)


def payload(data, lossless: bool) -> bytes:
    if not isinstance(data, np.ndarray):
        return bytes(int(math.fmod(v, 256)) % 256 if v == v and abs(v) != math.inf else 0 for v in data)
    if not lossless and data.dtype.kind == "i":
        return data.astype(np.uint8).tobytes()
    return data.astype(data.dtype.newbyteorder(">")).tobytes()


def offsets(counts: list[int]) -> list[int]:
    out, at = [], RESERVED
    for n in counts:
        out.append(at)
        at += n
    if at >> 32:
        raise WriterError("an offset does not fit into 32 bits")
    return out


def directory_of_keys(tags: dict, keys: dict[int, object]) -> None:
    """The directory has a row (key, tag that holds the value, count, value or place there) for each key; strings stand one after the other in one tag, each ended by NUL, doubles in another."""
    if 34735 in tags:
        return
    held = {34737: tags.get(34737, "").encode(), 34736: list(tags.get(34736, []))}
    given = [tag for tag in held if tag in tags]

    def entry(key: int, value: object) -> list[int]:
        if isinstance(value, int):
            return [key, 0, 1, value]
        tag, items = (34737, f"{value}\0".encode()) if isinstance(value, str) else (34736, np.atleast_1d(value).astype(float).tolist())
        if tag in given:  # the caller's own stands, and has no place for more
            return []
        place = len(held[tag])
        held[tag] += items
        return [key, tag, len(items), place]

    rows = [r for key in sorted(keys) if (r := entry(key, keys[key]))]
    tags[34735] = [1, 1, 0, len(rows), *(n for r in rows for n in r)]
    if held[34737] and 34737 not in given:
        tags[34737] = held[34737].decode()
    if held[34736] and 34736 not in given:
        tags[34736] = held[34736]


def directory(tags: dict) -> bytes:
    entries, extra = b"", b""
    begin = 8 + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind = writer_type(tag)
        if kind is None:
            raise WriterError(f"unknown type of tag {tag}")
        value = tags[tag]
        if (kind == "ASCII") != isinstance(value, str):
            raise WriterError(f"tag {tag} takes a {'string' if kind == 'ASCII' else 'number'}")
        if kind == "ASCII":
            data = value.encode() + (b"" if value.endswith("\0") else b"\0")
            n = len(data)
        else:
            n = len(value)
            if kind == "RATIONAL":
                data = b"".join(struct.pack(">II", math.floor(v * 10_000 + 0.5) & 0xFFFFFFFF, 10_000) for v in value)
            elif kind == "DOUBLE":
                data = struct.pack(f">{n}d", *value)
            else:
                code, mask = ("H", 0xFFFF) if kind == "SHORT" else ("I", 0xFFFFFFFF)
                data = struct.pack(f">{n}{code}", *(int(v) & mask for v in value))
        entries += struct.pack(">HHI", tag, TYPE_IDS[kind], n)
        if len(data) <= 4:
            entries += data.ljust(4, b"\0")
        else:
            entries += struct.pack(">I", begin + len(extra))
            extra += data + b"\0" * (len(data) & 1)
    out = b"MM\0\x2a" + struct.pack(">I", 8) + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0" + extra
    if len(out) > RESERVED:
        raise WriterError("the image directory is too large")
    return out


def write_blocks(arrays: list[np.ndarray], block: tuple[int, int] | None = None, compression: int = 1, predictor: int = 1, photometric: int = 1, little: bool = True, more: dict[int, tuple[int, list | bytes]] | None = None, overviews: list[list[np.ndarray]] | None = None, big: bool = False) -> bytes:
    """A file of several images in tiles (block: width, height) or one strip each, compressed: what sinks write at scale. arrays: (height, width) for each sample."""
    from tessel.sources.codecs import ENCODERS, predicted

    order = "<" if little else ">"
    word, inline, entry_head = ("Q", 8, "HHQ") if big else ("I", 4, "HHI")
    out = bytearray((b"II" if little else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for level, images in enumerate([arrays, *(overviews or [])]):
        height, width = images[0].shape
        w, h = block or (width, height)
        dtype = images[0].dtype
        stack = np.stack(images, -1)
        places, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = np.zeros((h, w, len(images)), dtype)
                cut = stack[y : y + h, x : x + w]
                part[: cut.shape[0], : cut.shape[1]] = cut
                data = part.astype(dtype.newbyteorder(order)).tobytes()
                if predictor == 2:
                    data = predicted(data, w, dtype.itemsize * 8, len(images), order)
                data = ENCODERS[compression](data)
                places.append(len(out))
                counts.append(len(data))
                out += data
        n, kind = len(images), FORMATS[dtype.kind]
        long = 16 if big else 4
        table: dict[int, tuple[int, list | bytes]] = {254: (4, [int(level > 0)]), 256: (4, [width]), 257: (4, [height]), 258: (3, [dtype.itemsize * 8] * n), 259: (3, [compression]), 262: (3, [photometric]), 277: (3, [n]), 284: (3, [1]), 317: (3, [predictor]), 339: (3, [kind] * n)}
        table |= {322: (4, [w]), 323: (4, [h]), 324: (long, places), 325: (long, counts)} if block else {273: (long, places), 278: (4, [h]), 279: (long, counts)}
        table |= more or {}
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + word, out, link, len(out))
        entries, extra = b"", b""
        begin = len(out) + (8 if big else 2) + (12 + 2 * (inline - 4) + 0 if not big else 20) * len(table) + inline
        codes = {2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
        for tag in sorted(table):
            kind, value = table[tag]
            data = value if isinstance(value, bytes) else struct.pack(f"{order}{len(value)}{codes[kind]}", *value)
            entries += struct.pack(order + entry_head, tag, kind, len(value))
            if len(data) <= inline:
                entries += data.ljust(inline, b"\0")
            else:
                entries += struct.pack(order + word, begin + len(extra))
                extra += data + b"\0" * (len(data) % 2)
        out += struct.pack(order + ("Q" if big else "H"), len(table)) + entries
        link = len(out)
        out += b"\0" * inline + extra
    return bytes(out)
