"""Byte sources: memory, local files, HTTP ranges, Hadoop file systems by way of Spark, and caches over them.

A reader is a function fetch(offset, size) that may return less at the end of the file.
"""

from __future__ import annotations

import re
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from tessel.errors import RasterError

CONTENT_RANGE = re.compile(r"^\s*bytes\s+(\d+)-(\d+)/(\d+|\*)\s*$", re.I)


@dataclass(frozen=True)
class HttpOptions:
    """max_ranges: how many ranges one request may ask for; 0 or 1: each range is a request, several at a time."""

    headers: dict[str, str] = field(default_factory=dict)
    max_ranges: int = 0
    allow_full_file: bool = False
    block_size: int = 65_536
    cache_size: int = 100


class MemoryReader:
    def __init__(self, data: bytes):
        self.data = bytes(data)

    def __call__(self, offset: int, size: int) -> bytes:
        return self.data[offset : offset + size]


class ObjectReader:
    """Ranges of a file in an object store or file system that pyarrow knows (s3, gs, hdfs, abfs, file)."""

    def __init__(self, url: str):
        self.url, self.file = re.sub(r"^s3[an]:", "s3:", url), None
        if not re.match(r"(s3|gs|gcs|hdfs|viewfs|abfss?|file):", self.url):
            raise ValueError(f"no ranges of {url}")

    def __getstate__(self):
        return {"url": self.url, "file": None}

    def opened(self):
        if self.file is None:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.url))
            self.file = system.open_input_file(path)
        return self.file

    def __call__(self, offset: int, size: int) -> bytes:
        file = self.opened()
        return file.read_at(max(0, min(size, file.size() - offset)), offset) if offset < file.size() else b""


class FileReader:
    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def __call__(self, offset: int, size: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(offset)
            return f.read(size)


class HttpReader:
    """Ranges of one resource; an answer with the whole of it counts only where that is allowed, and its size may not change."""

    def __init__(self, url: str, options: HttpOptions | None = None):
        self.url, self.options = url, options or HttpOptions()
        self.size: int | None = None

    def __call__(self, offset: int, size: int) -> bytes:
        if size <= 0 or self.size is not None and offset >= self.size:
            return b""
        request = urllib.request.Request(self.url, headers=self.options.headers | {"Range": f"bytes={offset}-{offset + size - 1}"})
        try:
            with urllib.request.urlopen(request) as answer:
                body = answer.read()
                if answer.status == 206:
                    found = CONTENT_RANGE.match(answer.headers.get("Content-Range", ""))
                    if not found or int(found[1]) != offset:
                        raise RasterError("The server's Content-Range is not the range asked for")
                    self.note(found[3])
                    return body[:size]
                if not self.options.allow_full_file:
                    raise RasterError("Server responded with full file")
                self.note(str(len(body)))
                return body[offset : offset + size]
        except urllib.error.HTTPError as e:
            if e.code == 416:
                return b""
            raise RasterError("Error fetching data.") from e

    def many(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        """Several ranges (offset, size): max_ranges of them in a request, or each in its own, eight at a time."""
        most = self.options.max_ranges
        if most < 2 or len(ranges) < 2:
            with ThreadPoolExecutor(8) as pool:
                return list(pool.map(lambda r: self(*r), ranges))
        out: list[bytes] = []
        for a in range(0, len(ranges), most):
            out += self.at_once(ranges[a : a + most])
        return out

    def at_once(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        wanted = ",".join(f"{offset}-{offset + size - 1}" for offset, size in ranges)
        request = urllib.request.Request(self.url, headers=self.options.headers | {"Range": f"bytes={wanted}"})
        try:
            with urllib.request.urlopen(request) as answer:
                body, kind = answer.read(), content_type(answer.headers.get("Content-Type"))
                if answer.status == 206 and kind[0] == "multipart/byteranges":
                    parts = list(byte_ranges(body, kind[1].get("boundary", "")))
                elif answer.status == 206:  # the server made one range of them
                    found = CONTENT_RANGE.match(answer.headers.get("Content-Range", ""))
                    if not found:
                        raise RasterError("The server's Content-Range is not a range")
                    parts = [(int(found[1]), body, found[3])]
                elif self.options.allow_full_file:
                    parts = [(0, body, str(len(body)))]
                else:
                    raise RasterError("Server responded with full file")
        except urllib.error.HTTPError as e:
            if e.code == 416:
                return [b""] * len(ranges)
            raise RasterError("Error fetching data.") from e
        for _, _, total in parts:
            self.note(total)
        return [self.within(parts, *r) for r in ranges]

    def within(self, parts: list[tuple[int, bytes, str]], offset: int, size: int) -> bytes:
        for begin, data, _ in parts:
            if begin <= offset < begin + len(data):
                return data[offset - begin : offset - begin + size]
        if self.size is not None and offset >= self.size:
            return b""
        return self(offset, size)  # the server left it out

    def note(self, total: str) -> None:
        if total != "*":
            if self.size not in (None, int(total)):
                raise RasterError("The resource changed its size")
            self.size = int(total)


class BlockedReader:
    """Aligned blocks over any reader, the last used of them kept."""

    def __init__(self, fetch, block_size: int = 65_536, keep: int = 100):
        self.fetch, self.block_size, self.keep = fetch, block_size, keep
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def __call__(self, offset: int, size: int) -> bytes:
        first, last = offset // self.block_size, -(-(offset + size) // self.block_size)
        missing = [i for i in range(first, last) if i not in self.blocks]
        stretches = joined(missing)
        wanted = [(begin * self.block_size, (end - begin) * self.block_size) for begin, end in stretches]
        many = getattr(self.fetch, "many", None)
        for (begin, end), data in zip(stretches, many(wanted) if many and len(wanted) > 1 else [self.fetch(*w) for w in wanted], strict=True):
            for i in range(begin, end):
                self.blocks[i] = data[(i - begin) * self.block_size : (i - begin + 1) * self.block_size]
        out = b"".join(self.blocks[i] for i in range(first, last))
        for i in range(first, last):
            self.blocks.move_to_end(i)
        while len(self.blocks) > self.keep:
            self.blocks.popitem(last=False)
        at = offset - first * self.block_size
        return out[at : at + size]


def joined(numbers: list[int]) -> list[tuple[int, int]]:
    """Stretches of consecutive numbers, end exclusive."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and out[-1][1] == n:
            out[-1] = (out[-1][0], n + 1)
        else:
            out.append((n, n + 1))
    return out


class CachedReader:
    """Whole ranges by (offset, size), the last used up to so many bytes."""

    def __init__(self, fetch, capacity: int = 64 << 20):
        self.fetch, self.capacity, self.weight = fetch, capacity, 0
        self.ranges: OrderedDict[tuple[int, int], bytes] = OrderedDict()

    def __call__(self, offset: int, size: int) -> bytes:
        key = (offset, size)
        if key not in self.ranges:
            self.ranges[key] = self.fetch(offset, size)
            self.weight += len(self.ranges[key])
        self.ranges.move_to_end(key)
        out = self.ranges[key]
        while self.weight > self.capacity and self.ranges:
            self.weight -= len(self.ranges.popitem(last=False)[1])
        return out


def content_type(header: str | None) -> tuple[str, dict[str, str]]:
    """The kind in lower case, and its parameters."""
    kind, *params = (header or "").split(";")
    pairs = (p.partition("=") for p in params if "=" in p)
    return kind.strip().lower(), {k.strip().lower(): v.strip().strip('"') for k, _, v in pairs}


def headers_of(text: str) -> dict[str, str]:
    """Header lines as a map, names in lower case."""
    pairs = [line.partition(":") for line in text.split("\r\n") if line]
    if any(not colon for _, colon, _ in pairs):
        raise RasterError(f"not a header: {text}")
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def byte_ranges(body: bytes, boundary: str) -> Iterator[tuple[int, bytes, str]]:
    """The parts of a multipart/byteranges body: offset, bytes, the whole's size. A part is as long as its Content-Range says, whatever its bytes are."""
    mark = b"--" + boundary.encode()
    at = body.find(mark) if boundary else -1
    if at < 0:
        raise RasterError("The answer has no boundary of its parts")
    while body[at : at + len(mark)] == mark:
        at += len(mark)
        if body[at : at + 2] == b"--":
            return
        stop = body.find(b"\r\n\r\n", at)
        if body[at : at + 2] != b"\r\n" or stop < 0:
            raise RasterError("A part of the answer has no headers")
        found = CONTENT_RANGE.match(headers_of(body[at + 2 : stop].decode("latin-1")).get("content-range", ""))
        if not found or int(found[2]) < int(found[1]):
            raise RasterError("A part of the answer has no Content-Range")
        size = int(found[2]) - int(found[1]) + 1
        data = body[stop + 4 : stop + 4 + size]
        if len(data) < size or body[stop + 4 + size : stop + 6 + size] != b"\r\n":
            raise RasterError("A part of the answer is not as long as its Content-Range")
        yield int(found[1]), data, found[3]
        at = stop + 6 + size
    raise RasterError("A part of the answer does not begin with the boundary")


def open_reader(path: str, options: HttpOptions | None = None):
    if re.match(r"https?://", path):
        options = options or HttpOptions()
        return BlockedReader(HttpReader(path, options), options.block_size, options.cache_size)
    return ObjectReader(path) if "://" in path and not path.startswith("file:") else FileReader(path)
