"""Operator 3: near-duplicates by SimHash, found on blocks of bits.

A fingerprint has a bit where over half the hashes of a text's shingles have it. Texts
link at DISTANCE = 2 differing bits or fewer, and groups are the connected components.

Pigeonhole: of BLOCKS = 4 blocks of 16 bits, two differing bits touch two at most, so a
close pair shares two blocks. Fingerprints (each once, however many documents have it)
are joined on each of the 6 pairs of blocks, and joined ones are held against each other
bit by bit. 32 bits of a key, not 21 as with three blocks, keep chance matches rare: of
10^9 fingerprints a key has 0.25 on average.

A key that over HOT fingerprints share would give their square of candidates. Fingerprints
that have such a key meet in another way, as exact: both of a close pair are within one
bit of a common value, so each goes to itself and its 64 neighbours by one bit, and those
that meet there are linked in a chain of two bits each. That is 65 rows a fingerprint
however many share the key.

Null text counts as empty: no words, fingerprint zero, which links like any other.
Repeated rows have one fingerprint. Rows with a null doc_id take part, and a component of
them only has a null component_id. An empty table gives an empty result.

The pipeline's stage has a rule of its own: tessel.llm.similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import checkpointed, shuffles_released, table, with_row_id
from tessel.llm.components import components
from tessel.llm.xxh import xxh64

SHINGLE, DISTANCE, BLOCKS, HOT = 3, 2, 4, 64
#: Bytes of text hashed at once.
AT_ONCE = 1 << 20


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """uint64 of each text; the hashes of a text are counted bit by bit."""
    out = np.zeros(len(texts), np.uint64)
    part: list[bytes] = []
    size = begin = 0
    for i, t in enumerate(texts):
        part.append(b" ".join(t.lower().split()))  # bytes: A-Z and ASCII white space only
        size += len(part[-1])
        if size >= AT_ONCE or i == len(texts) - 1:
            out[begin : i + 1] = hashed(part, shingle)
            part, size, begin = [], 0, i + 1
    return out


def shingles(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with single spaces between words, none at the ends: all bytes, where each shingle begins and its size, its text, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    gaps = np.flatnonzero((data == 32) | (data == 10))  # the separators written here; other control characters are parts of words
    starts = np.unique(np.concatenate([begins[sizes > 0], gaps + 1 if len(gaps) else gaps]))
    starts = starts[starts < len(data)]
    text_of = np.searchsorted(begins, starts, "right") - 1
    real = starts < (begins + sizes)[text_of]  # an empty text between others has no word
    starts, text_of = starts[real], text_of[real]
    counts = np.bincount(text_of, minlength=len(texts))
    firsts = np.cumsum(counts) - counts
    ends = np.append(starts[1:] - 1, len(data))
    ends = np.minimum(ends, (begins + sizes)[text_of])
    n = np.where(counts == 0, 0, np.maximum(1, counts - shingle + 1))
    owner = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + firsts[owner]
    last = np.minimum(k + shingle - 1, (firsts + counts)[owner] - 1)
    return data, starts[k], ends[last] - starts[k], owner, n


def hashed(texts: list[bytes], shingle: int) -> np.ndarray:
    """texts have single spaces between words, none at the ends."""
    data, places, lengths, owner, n = shingles(texts, shingle)
    out = np.zeros(len(texts), np.uint64)
    step = 1 << 15
    ones = np.zeros((len(texts), 64), np.int64)
    for a in range(0, len(owner), step):
        b = a + step
        h = xxh64(data, places[a:b], lengths[a:b])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[a:b]
        edge = np.flatnonzero(np.diff(mine, prepend=mine[0] - 1))
        ones[mine[edge]] += np.add.reduceat(bits.astype(np.int32), edge, axis=0)
    over = ones * 2 > n[:, None]
    out[:] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs with the fingerprint of text as a long (its bits as they are)."""
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            found = fingerprints([(x.as_py() or "").encode() for x in column])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, out)


def keys(fp: Column, blocks: int = BLOCKS, distance: int = DISTANCE) -> Column:
    """The keys of fp: for each choice of blocks - distance blocks, these blocks' bits with the rest zero, and the choice."""
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * i) for i in kept) for kept in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)))


def linked(nodes: DataFrame) -> DataFrame:
    """nodes: distinct longs fp. Edges a, b whose components are those of all pairs within DISTANCE = 2 bits."""
    keyed = nodes.select("fp", F.explode(keys(F.col("fp"))).alias("k")).select("fp", "k.choice", "k.value")
    shared = keyed.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = checkpointed(keyed.join(shared, ["choice", "value"]))
    cold = sized.where(F.col("n") <= HOT)
    other = cold.select("choice", "value", F.col("fp").alias("b"))
    pairs = cold.withColumnRenamed("fp", "a").join(other, ["choice", "value"]).where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    flips = [F.lit(0).cast("long"), *(F.lit(-(1 << 63) if i == 63 else 1 << i) for i in range(64))]
    hot = sized.where(F.col("n") > HOT).select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    least = hot.groupBy("middle").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    meeting = hot.join(least, "middle").select(F.col("fp").alias("a"), "b").where("a <> b")
    return pairs.union(meeting)


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a column fp; and per fingerprint: fp, component (a fingerprint)."""
    nodes = docs.select("fp").distinct()
    found = components(linked(nodes))
    return docs, nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fingerprint, component_id."""
    prints = checkpointed(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    _, group_of = grouped(prints)
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(group_of, "fp")
    named = smallest.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = group_of.join(named, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (tessel.llm.similar) stays: that of the smallest doc_id, a null one last, and of repeated rows the first."""
    named = with_row_id(docs, "row of the table")
    from tessel.llm import similar  # it builds on this module

    with shuffles_released(spark):
        group_of = similar.groups(named)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("row of the table"))).alias("first")
    kept = group_of.groupBy("component").agg(first).select(F.col("first")["row of the table"].alias("row of the table"))
    return named.join(kept, "row of the table", "left_semi").select(*docs.columns)
