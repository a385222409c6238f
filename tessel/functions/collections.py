"""Array, map and header helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def counted(n: Column | int) -> Column:
    """0, 1, ... n - 1; nothing for n = 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long"))), lambda i: i < n)


def times(n: Column | int, function) -> Column:
    return F.transform(counted(n), function)


def chunk(array: Column, n: int) -> Column:
    """Arrays of n elements each, the last filled up with nulls; none for n = 0."""
    if n <= 0:
        return F.filter(F.array(array), lambda _: F.lit(False))
    groups = F.ceil(F.size(array) / n).cast("int")
    return times(groups, lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(array, (i * n).cast("int") + j)))


def zipped(a: Column, b: Column) -> Column:
    """Pairs as long as a; b's missing elements are null."""
    return F.transform(a, lambda x, i: F.struct(x.alias("a"), F.get(b, i).alias("b")))


def inverted(m: Column) -> Column:
    """Values to keys; of keys with one value the last counts."""
    entries = F.map_entries(m)
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["value"].alias("key"), e["key"].alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries)), lambda o: o["value"] == e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def assigned(target: Column, source: Column) -> Column:
    """Both maps' entries; of a key in both the source's."""
    kept = F.map_filter(target, lambda k, _: ~F.map_contains_key(source, k))
    return F.map_concat(kept, source)


def ends_with(text: Column, suffix: Column) -> Column:
    return F.coalesce(text.endswith(suffix), F.lit(False))


def header_map(lines: Column) -> Column:
    """Header lines `Name: value` as a map of lower-case names; of a name given twice the last counts."""
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda e: ~F.exists(F.slice(pairs, e["i"] + 2, F.size(pairs)), lambda o: o["k"] == e["p"]["k"]))
    return F.map_from_entries(F.transform(last, lambda e: e["p"]))


def strict_content_range(header: Column) -> Column:
    """`bytes 0-99/200` as a struct first, last, size; null unless all three are numbers, in order, and the size holds them."""
    parts = content_range(header)
    good = (F.lower(parts["unit"]) == "bytes") & (parts["first"] <= parts["last"]) & (parts["last"] < parts["size"])
    return F.when(good, F.struct(parts["first"].alias("first"), parts["last"].alias("last"), parts["size"].alias("size")))


def content_range(header: Column) -> Column:
    """`bytes 0-99/200` as a struct unit, first, last, size; null where it isn't one. An unknown size (*) is null."""
    pattern = r"^\s*(\w+)\s+(\d+)-(\d+)/(\d+|\*)\s*$"
    part = lambda i: F.regexp_extract(header, pattern, i)
    good = header.rlike(pattern)
    size = F.when(part(4) != "*", part(4).try_cast("long"))
    return F.when(good, F.struct(part(1).alias("unit"), part(2).try_cast("long").alias("first"), part(3).try_cast("long").alias("last"), size.alias("size")))


def unsatisfied_range(header: Column) -> Column:
    """The size in `bytes */200`, else null."""
    return F.regexp_extract(header, r"^\s*bytes\s+\*/(\d+)\s*$", 1).try_cast("long")


def content_type(header: Column) -> Column:
    """`multipart/byteranges; boundary=x` as a struct kind, params (a map of lower-case names)."""
    params = F.filter(F.transform(F.slice(F.split(header, ";"), 2, 1 << 16), lambda p: F.trim(p)), lambda p: p.contains("="))
    pairs = F.transform(params, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))), F.regexp_replace(F.trim(F.regexp_replace(p, r"^[^=]*=", "")), r"^\"|\"$", "")))
    return F.struct(F.lower(F.trim(F.get(F.split(header, ";"), 0))).alias("kind"), F.map_from_entries(pairs).alias("params"))


def tie_points(values: Column) -> Column:
    """Groups of six numbers as structs i, j, k, x, y, z; null unless the count is a multiple of six."""
    names = ("i", "j", "k", "x", "y", "z")
    groups = times((F.size(values) / 6).cast("int"), lambda g: F.struct(*(F.get(values, (g * 6 + i).cast("int")).alias(n) for i, n in enumerate(names))))
    return F.when(F.size(values) % 6 == 0, groups)


def ghost_values(header: Column) -> Column:
    """A header of KEY=VALUE lines as a map."""
    lines = F.filter(F.split(header, "\n"), lambda line: line.contains("="))
    return F.map_from_entries(F.transform(lines, lambda line: F.struct(F.substring_index(line, "=", 1), F.regexp_replace(line, r"^[^=]*=", ""))))
