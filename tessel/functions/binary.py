"""Reads of numbers from bytes, by Python on single buffers and as Columns on BINARY columns."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.errors import RasterError

CODES = {"uint8": "B", "int8": "b", "uint16": "H", "int16": "h", "uint32": "I", "int32": "i", "uint64": "Q", "int64": "q", "float16": "e", "float32": "f", "float64": "d"}


class View:
    """Numbers of a buffer by offset, either byte order."""

    def __init__(self, data: bytes):
        self.data = data

    def get(self, kind: str, offset: int, little: bool = False):
        size = struct.calcsize(CODES[kind])
        if offset < 0 or offset + size > len(self.data):
            raise RasterError("Offset is outside the bounds of the DataView")
        return struct.unpack_from(("<" if little else ">") + CODES[kind], self.data, offset)[0]


class Slice:
    """Part of a file: numbers by offset in the file."""

    def __init__(self, data: bytes, offset: int, little: bool, big: bool):
        self.view, self.offset, self.little, self.big = View(data), offset, little, big

    @property
    def top(self) -> int:
        return self.offset + len(self.view.data)

    def covers(self, offset: int, size: int) -> bool:
        return self.offset <= offset and offset + size <= self.top

    def read(self, kind: str, offset: int):
        return self.view.get(kind, offset - self.offset, self.little)

    def read_offset(self, offset: int) -> int:
        return self.read("uint64" if self.big else "uint32", offset)


def unsigned(data: Column, offset: Column | int, size: int, little: bool = False) -> Column:
    """An unsigned integer of up to 8 bytes in a BINARY column, as DECIMAL(20, 0); null past its end."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    part = F.substring(data, at + 1, F.lit(size))
    part = F.unhex(F.array_join(F.reverse(F.array(*(F.hex(F.substring(part, F.lit(i + 1), F.lit(1))) for i in range(size)))), "")) if little else part
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("decimal(20,0)"))


def signed(data: Column, offset: Column | int, size: int, little: bool = False) -> Column:
    value = unsigned(data, offset, size, little)
    return F.when(value >= F.lit(1 << (8 * size - 1)).cast("decimal(20,0)"), value - F.lit(1 << (8 * size)).cast("decimal(21,0)")).otherwise(value).cast("long")
