"""The structure of TIFF and BigTIFF files: header, directories, tags, GeoKeys.

parse() reads them through a function `fetch(offset, size)`, which may return less at the
end of the file, so that a reader of a remote file fetches little more than its
directories.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np

from tessel.errors import ImageIndexError, RasterError
from tessel.functions.dictionary import FIELD_SIZES, GEO_KEYS, get_tag, resolve_tag, tag_name

Fetch = Callable[[int, int], bytes]

PREFIX = 64 << 10
MOST_DIRECTORIES, MOST_ENTRIES = 65_536, 1_000_000
#: numpy's names of field types; 5 and 10 are pairs.
DTYPES = {1: "u1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 10: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}


@dataclass
class Tag:
    """A tag's value: a string, a list of numbers (rationals as numerator, denominator by turns), and whether it reads as an array."""

    tag: int
    field_type: int
    count: int
    value: str | list
    is_array: bool

    @property
    def name(self) -> str:
        return tag_name(self.tag)

    def plain(self):
        return self.value if isinstance(self.value, str) or self.is_array else self.value[0]

    def __len__(self) -> int:
        return len(self.value)

    def indexed(self, i: int):
        """One element, or None beyond them; of a string a character."""
        return self.value[i] if 0 <= i < len(self.value) else None

    def whole(self) -> list[int] | None:
        """As whole numbers, if all of them are, and none is negative."""
        good = not isinstance(self.value, str) and all(v >= 0 and v == int(v) for v in self.value)
        return [int(v) for v in self.value] if good else None

    def numbers(self) -> list[float]:
        """As quotients where it's rational."""
        if self.field_type in (5, 10):
            return [n / d if d else float("nan") for n, d in zip(self.value[0::2], self.value[1::2], strict=True)]
        return [] if isinstance(self.value, str) else self.value


@dataclass
class Directory:
    """One image of a file."""

    tags: dict[int, Tag]
    order: str
    big: bool
    next_offset: int
    geo_keys: dict[int, object] = field(default_factory=dict)

    def has_tag(self, tag: int | str) -> bool:
        return resolve_tag(tag) in self.tags

    def get(self, tag: int | str, default=None):
        found = self.tags.get(resolve_tag(tag))
        return default if found is None else found.plain()

    def first(self, tag: int | str, default=None):
        found = self.tags.get(resolve_tag(tag))
        return found.value[0] if found and found.value else default

    def numbers(self, tag: int | str) -> list | None:
        found = self.tags.get(resolve_tag(tag))
        return None if found is None else found.numbers()

    def indexed(self, tag: int | str, i: int):
        """One element of a tag."""
        found = self.tags.get(resolve_tag(tag))
        return None if found is None else found.indexed(i)

    def __len__(self) -> int:
        return len(self.tags)

    def __iter__(self):
        return (self.tags[t] for t in sorted(self.tags))

    def to_object(self) -> dict:
        return {self.tags[t].name: self.tags[t].plain() for t in sorted(self.tags)}

    @property
    def width(self) -> int:
        return self.first("ImageWidth", 0)

    @property
    def height(self) -> int:
        return self.first("ImageLength", 0)

    @property
    def samples(self) -> int:
        return self.first("SamplesPerPixel", 1)

    @property
    def tiled(self) -> bool:
        return not self.has_tag("StripOffsets")

    @property
    def planar(self) -> int:
        return self.first("PlanarConfiguration", 1)

    @property
    def compression(self) -> int:
        return self.first("Compression", 1)

    @property
    def predictor(self) -> int:
        return self.first("Predictor", 1)

    @property
    def photometric(self) -> int | None:
        return self.first("PhotometricInterpretation")

    @property
    def bits(self) -> list[int]:
        """0 where the tag is absent: such an image can be described but not decoded."""
        return spread(self.numbers("BitsPerSample"), self.samples, 0)

    @property
    def formats(self) -> list[int]:
        return spread(self.numbers("SampleFormat"), self.samples, 1)

    @property
    def block_width(self) -> int:
        return self.first("TileWidth", 0) if self.tiled else self.width

    @property
    def block_height(self) -> int:
        if self.tiled:
            return self.first("TileLength", 0)
        return min(self.first("RowsPerStrip", 0) or self.height, self.height)

    def height_of(self, by: int) -> int:
        """Of the blocks in row by: the last strip is short, tiles are whole."""
        return self.block_height if self.tiled else max(0, min(self.block_height, self.height - by * self.block_height))

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width) if self.block_width else 0

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height) if self.block_height else 0

    @property
    def bytes_per_pixel(self) -> int:
        return sum(-(-b // 8) for b in self.bits)

    @property
    def nodata(self) -> float | None:
        """The last character is dropped, as files end the text with NUL; what isn't a number is NaN."""
        text = self.get("GDAL_NODATA")
        return None if text is None else number(text[:-1])

    @property
    def offsets(self) -> list[int]:
        return self.numbers("TileOffsets" if self.tiled else "StripOffsets") or []

    @property
    def byte_counts(self) -> list[int]:
        return self.numbers("TileByteCounts" if self.tiled else "StripByteCounts") or []

    def gdal_metadata(self, sample: int | None = None) -> dict[str, str] | None:
        """The items of a sample; without one those of no sample."""
        text = self.get("GDAL_METADATA")
        if text is None:
            return None
        items = ElementTree.fromstring(text.rstrip("\0")).iter("Item")
        return {i.get("name", ""): i.text or "" for i in items if i.get("sample") == (None if sample is None else str(sample))}


def spread(found: list | None, count: int, default: int) -> list[int]:
    """One for each sample; missing ones as the first."""
    found = found or [default]
    return (found + [found[0]] * count)[:count]


def number(text: str) -> float:
    """A string as JavaScript's Number() reads it."""
    text = text.strip(" \t\n\r\v\f\0﻿ ") if "\0" not in text else text
    if not text:
        return 0.0
    sign, rest = (-1.0, text[1:]) if text[0] == "-" else (1.0, text[1:] if text[0] == "+" else text)
    if rest == "Infinity":
        return sign * float("inf")
    try:
        if text[:2].lower() in ("0x", "0o", "0b"):
            return float(int(text[2:], {"x": 16, "o": 8, "b": 2}[text[1].lower()]))
        if any(c not in "0123456789.eE+-" for c in text):
            return float("nan")
        return float(text)
    except ValueError:
        return float("nan")


class Cursor:
    """Reads by offset, keeping the file's first PREFIX bytes."""

    def __init__(self, fetch: Fetch):
        self.fetch, self.prefix = fetch, fetch(0, PREFIX)

    def read(self, offset: int, size: int) -> bytes:
        part = self.prefix[offset : offset + size] if offset + size <= len(self.prefix) else self.fetch(offset, size)
        if len(part) < size:
            raise RasterError("Offset is outside the bounds of the DataView")
        return part


def parse(fetch: Fetch) -> list[Directory]:
    """Every directory of the file, in the order of its chain."""
    cursor = Cursor(fetch)
    head = cursor.read(0, 8)
    if head[:2] not in (b"II", b"MM"):
        raise RasterError("Invalid byte order value.")
    order = "<" if head[:2] == b"II" else ">"
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43):
        raise RasterError("Invalid magic number.")
    big = magic == 43
    if big:
        size, reserved = struct.unpack(order + "HH", head[4:8])
        if size != 8:
            raise RasterError("Unsupported offset byte-size.")
        if reserved:
            raise RasterError("Invalid BigTIFF reserved header field")
        offset = struct.unpack(order + "Q", cursor.read(8, 8))[0]
    else:
        offset = struct.unpack(order + "I", head[4:8])[0]
    out: list[Directory] = []
    seen: set[int] = set()
    while offset:
        if offset in seen:
            raise RasterError("Cycle in the chain of image directories")
        if len(out) >= MOST_DIRECTORIES:
            raise RasterError("Too many image directories")
        seen.add(offset)
        out.append(directory(cursor, offset, order, big))
        offset = out[-1].next_offset
    return out


def directory(cursor: Cursor, offset: int, order: str, big: bool) -> Directory:
    head, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    n = struct.unpack(order + head, cursor.read(offset, struct.calcsize(order + head)))[0]
    if n > MOST_ENTRIES:
        raise RasterError("Too many entries in an image directory")
    begin, inline = offset + struct.calcsize(order + head), 8 if big else 4
    table = cursor.read(begin, n * entry)
    tags: dict[int, Tag] = {}
    for i in range(n):
        part = table[i * entry : (i + 1) * entry]
        tag, kind, count = struct.unpack(order + "HH" + word, part[: 4 + inline])
        if kind not in FIELD_SIZES:
            raise RasterError(f"Invalid field type: {kind}")
        size = FIELD_SIZES[kind] * count
        data = part[4 + inline :][:size] if size <= inline else cursor.read(struct.unpack(order + word, part[4 + inline :])[0], size)
        tags[tag] = decoded(tag, kind, count, data, order)
    next_offset = struct.unpack(order + word, cursor.read(begin + n * entry, inline))[0]
    out = Directory(dict(sorted(tags.items())), order, big, next_offset)
    out.geo_keys = geo_keys(out)
    return out


def decoded(tag: int, kind: int, count: int, data: bytes, order: str) -> Tag:
    known = get_tag(tag)
    forced = bool(known and known[3])
    if kind == 2:
        return Tag(tag, kind, count, data.decode("utf-8", "replace"), False)
    values = np.frombuffer(data, order + DTYPES[kind]).tolist()
    return Tag(tag, kind, count, values, forced or count != 1 or kind in (5, 10))


def geo_keys(found: Directory) -> dict[int, object]:
    """Key to value: a number, an array of numbers, or a string without its last byte."""
    raw = found.numbers("GeoKeyDirectory")
    if not raw:
        return {}
    if raw[:2] != [1, 1] or len(raw) < 4:
        raise RasterError("Unsupported version of the GeoKey directory")
    out: dict[int, object] = {}
    for i in range(4, min(4 + 4 * raw[3], len(raw) - 3), 4):
        key, place, count, value = raw[i : i + 4]
        if place == 0:
            out[key] = value
            continue
        tag = found.tags.get(place)
        if tag is None:
            raise RasterError(f"GeoKey {key} refers to tag {place}, which isn't there")
        part = tag.value[value : value + count]
        out[key] = part[:-1] if isinstance(part, str) else part[0] if count == 1 and part else part
    return dict(sorted(out.items()))


def named_geo_keys(found: Directory) -> dict[str, object]:
    return {GEO_KEYS[k]: v for k, v in found.geo_keys.items() if k in GEO_KEYS}


def image(found: list[Directory], index: int) -> Directory:
    if not 0 <= index < len(found):
        raise ImageIndexError(index)
    if found[index].planar not in (1, 2):
        raise RasterError("Invalid planar configuration.")
    return found[index]


def ghost(fetch: Fetch, big: bool = False) -> dict[str, str] | None:
    """The key=value lines of a structural header behind the file's header."""
    begin, mark = 16 if big else 8, b"GDAL_STRUCTURAL_METADATA_SIZE="
    head = fetch(begin, len(mark) + 100)
    if not head.startswith(mark):
        return None
    line, _, _ = head.partition(b"\n")
    size = int(line[len(mark) :].split()[0])
    text = fetch(begin, len(line) + 1 + size)[len(line) + 1 :].decode("utf-8", "replace")
    return dict(part.split("=", 1) for part in text.split("\n") if "=" in part)
