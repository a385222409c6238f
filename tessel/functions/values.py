"""Conversions of sample values as Column expressions. All are null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {"uint8": 8, "uint16": 16, "uint32": 32, "int8": 8, "int16": 16, "int32": 32}


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def wrapped(value: Column, bits: int, signed: bool = False) -> Column:
    """A number as an integer of so many bits: not finite 0, truncated toward zero, modulo 2^bits."""
    whole = F.when(finite(value.cast("double")), F.signum(value.cast("double")) * F.floor(F.abs(value.cast("double"))).cast("double")).otherwise(F.lit(0.0))
    size = float(1 << bits)
    low = whole - F.floor(whole / size) * size
    low = F.when(value.isNotNull(), low)
    return (F.when(low >= size / 2, low - size).otherwise(low) if signed else low).cast("long")


def to_uint8(value: Column) -> Column:
    return wrapped(value, 8)


def to_uint8_clamp(value: Column) -> Column:
    """0 to 255, halves to even, NaN 0."""
    value = value.cast("double")
    return F.when(F.isnan(value), F.lit(0)).otherwise(F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value)))).cast("long")


def stored(value: Column, dtype: str) -> Column:
    """value as it comes out of an array of dtype."""
    if dtype in BITS:
        return wrapped(value, BITS[dtype], dtype.startswith("int"))
    if dtype == "uint8c":
        return to_uint8_clamp(value)
    return value.cast({"float32": "float", "float64": "double", "int64": "long", "uint64": "decimal(20,0)"}[dtype])


def js_round(value: Column) -> Column:
    """Halves toward positive infinity."""
    return F.floor(value + F.lit(0.5))


def sign_extended(value: Column, bits: int) -> Column:
    """An unsigned value of so many bits read as two's complement."""
    return F.when(value >= (1 << (bits - 1)), value - (1 << bits)).otherwise(value)


def js_number(text: Column) -> Column:
    """A string as a double: blank 0, 0x, 0o and 0b prefixes, Infinity in this spelling only, anything else NaN."""
    t = F.regexp_replace(text, r"^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    digits = F.substring(t, 3, 64)
    radix = F.when(t.rlike(r"^0[xX][0-9a-fA-F]+$"), F.conv(digits, 16, 10)).when(t.rlike(r"^0[oO][0-7]+$"), F.conv(digits, 8, 10)).when(t.rlike(r"^0[bB][01]+$"), F.conv(digits, 2, 10))
    number = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    infinite = F.when(t.isin("Infinity", "+Infinity"), F.lit(float("inf"))).when(t == "-Infinity", F.lit(float("-inf")))
    value = F.coalesce(F.when(t == "", F.lit(0.0)), radix.try_cast("double"), number, infinite, F.lit(float("nan")))
    return F.when(text.isNotNull(), value)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return (F.lit(1.0) - t) * a + t * b


def range_sum(array: Column, start: Column | int, stop: Column | int) -> Column:
    """The sum of array[start:stop] as a double; null elements count as 0."""
    start, stop = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop))
    part = F.when(stop > start, F.slice(array, start + 1, stop - start)).otherwise(F.slice(array, 1, 0))
    return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))


def is_float(dtype: str) -> bool:
    return dtype in ("float32", "float64")


def is_int(dtype: str) -> bool:
    return dtype in ("int8", "int16", "int32")


def is_uint(dtype: str) -> bool:
    return dtype in ("uint8", "uint8c", "uint16", "uint32")
