"""The pipeline's near duplicates: texts of similarity SIMILAR = 0.8 or more.

Similarity is the Jaccard index of two texts' sets of shingles of SHINGLE = 5 words; a
text of fewer words is one shingle. SimHash comes first, by operator 3's own functions:
texts whose fingerprints (of these shingles) differ in 2 bits or fewer are candidates, one
text of each fingerprint for its links to others. At 0.8 fingerprints of 64 bits differ in
some 10 bits, for which pigeonhole keys would be too short to join on. So the candidates
that lie further apart are found by minima of hashes: BANDS = 20 keys of ROWS = 4 minima
each. A pair at 0.8 shares a key with
probability 1 - (1 - 0.8 ^ 4) ^ 20 = 0.99997. Candidates are then held against each other
shingle by shingle, so no pair below 0.8 links.

Equal texts are one node. First each key's nodes are compared with one of them, its lead,
or with LEADS = 3 if over HOT = 64 nodes have the key. Then those that share a key and
still are in different components are compared, all with each other if HOT nodes or fewer
have it. Nodes of hotter keys are joined on their prefixes instead: of n shingles, ordered
from rare to frequent, the first n - ceil(0.8 n) + 1. Two sets at 0.8 have one of those in
common, and at the first common one enough shingles are left in both, so no pair is missed,
while texts that have only a frequent passage in common don't meet. How frequent a shingle
is, is counted in CELLS cells over all those texts; any order would give the same pairs.
Each bit of a map of MAP = 512 that one set has and the other lacks is a shingle not in
common, which rules out most pairs before sets are compared. Of the nodes that meet at a
shingle those of its largest component don't meet each other, and one side of a shingle is
dealt to a task for each BLOCK = 1024 that have it, so no frequent one is one task's work.
A key or shingle that over 1 / PARTS of all rows have gets its aggregate by broadcast, as
there are fewer than PARTS.

Texts are shuffled once, when the sets of those that share a key are made; the sets are
kept for all that follows.

Null text counts as empty, and empty texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import simhash
from tessel.llm.common import checkpointed, total
from tessel.llm.components import components
from tessel.llm.xxh import xxh64

SHINGLE, SIMILAR, BANDS, ROWS, HOT, LEADS = 5, 0.8, 20, 4, 64, 3
CELLS, PARTS, MAP, BLOCK = 1 << 20, 4096, 512, 1024
BITS = [f"bits{w}" for w in range(MAP // 64)]
ROW = "row of the table"
_random = np.random.default_rng(5)
FLIP = _random.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)
TIMES = _random.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of normal texts, and the text that has it."""
    data, begins, sizes, owner, _ = simhash.shingles(texts, SHINGLE)
    parts = [xxh64(data, begins[a : a + (1 << 15)], sizes[a : a + (1 << 15)]) for a in range(0, len(owner), 1 << 15)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), owner


def bands(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """int64 of each normal text and band, and the number of different shingles of each text."""
    h, owner = hashes(texts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    sizes = np.bincount(owner, minlength=len(texts))
    least = np.full((len(texts), BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 1 << 15):
        mine, some = owner[a : a + (1 << 15)], h[a : a + (1 << 15)]
        edge = np.flatnonzero(np.diff(mine, prepend=mine[0] - 1))
        at = mine[edge]
        for i in range(BANDS * ROWS):
            least[at, i] = np.minimum(least[at, i], np.minimum.reduceat((some ^ FLIP[i]) * TIMES[i] >> np.uint64(16), edge))
    flat = np.ascontiguousarray(least.reshape(len(texts), BANDS, ROWS))
    flat ^= np.arange(BANDS, dtype=np.uint64)[None, :, None] << np.uint64(56)
    keys = xxh64(flat.view(np.uint8).ravel(), np.arange(len(texts) * BANDS) * ROWS * 8, np.full(len(texts) * BANDS, ROWS * 8))
    return keys.view(np.int64).reshape(len(texts), BANDS), sizes


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Where to cut texts so that each part has about simhash.AT_ONCE bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= simhash.AT_ONCE or i == len(texts) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def digested(docs: DataFrame) -> DataFrame:
    """docs: ROW, doc_id, text. Instead of text: the digest of the normal text, its number of different shingles, its SimHash fingerprint (fp) and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(x.as_py()) for x in batch.column(2)]
            for a, b in batches_of(texts):
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts[a:b]), np.int64).reshape(-1, 2)
                keys, sizes = bands(texts[a:b])
                prints = simhash.hashed(texts[a:b], SHINGLE).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(sizes, pa.int64()), pa.array(prints), lists], names=[ROW, "doc_id", "h1", "h2", "size", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(ROW, "doc_id", "text").mapInArrow(run, f"`{ROW}` long, doc_id {kind}, h1 long, h2 long, size long, fp long, keys array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """docs: ROW, text. Instead of text the different hashes of its shingles (hashes): a chance pair of 64 bits would count as one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(x.as_py()) for x in batch.column(1)]
            for a, b in batches_of(texts):
                h, owner = hashes(texts[a:b])
                edges = np.searchsorted(owner, np.arange(b - a + 1))
                each = [np.unique(h[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                ends = np.cumsum([0, *(len(e) for e in each)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=[ROW, "hashes"])

    return docs.select(ROW, "text").mapInArrow(run, f"`{ROW}` long, hashes array<long>")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of pairs a, b (rows of held: ROW, hashes) those whose sets are similar; computed once. Sets are compared in the JVM, row by row: Arrow batches of both texts of pairs would be large."""
    pairs = checkpointed(pairs.distinct())
    ids = pairs.select(F.col("a").alias(ROW)).union(pairs.select("b")).distinct()
    held = held.join(ids, ROW, "left_semi")
    first = held.select(F.col(ROW).alias("a"), F.col("hashes").alias("x"))
    second = held.select(F.col(ROW).alias("b"), F.col("hashes").alias("y"))
    both, m, n = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    fits = F.least(m, n) >= F.greatest(m, n) * (SIMILAR - 1e-9)
    similar = F.when(fits, both >= (m + n - both) * (SIMILAR - 1e-9)).otherwise(False)
    return checkpointed(pairs.join(first, "a").join(second, "b").where(similar).select("a", "b"))


def shared_keys(rows: DataFrame, *values) -> tuple[DataFrame, DataFrame]:
    """The keys that several rows have, with their number (sharers) and values; and those of them that are too heavy for one task."""
    shared = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("sharers"), *values).where("sharers > 1"))
    many = shared.agg(F.coalesce(F.sum("sharers"), F.lit(0))).first()[0]
    return shared, shared.where(F.col("sharers") > max(HOT, many // PARTS)).select("key")  # fewer than PARTS rows


def on_key(rows: DataFrame, other: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows with the row that other has for their key."""
    hot = F.broadcast(other.join(F.broadcast(heavy), "key"))
    return rows.join(F.broadcast(heavy), "key", "left_anti").join(other, "key").unionByName(rows.join(hot, "key"))


def near(texts: DataFrame) -> DataFrame:
    """texts: node, size, fp. By SimHash: a, m, b, n (two nodes and their sizes) of each text and the first one of its fingerprint, and of the first ones of fingerprints that operator 3 links."""
    first = F.min(F.struct("node", "size")).alias("l")
    rows = texts.select("node", "size", F.col("fp").alias("key"))
    shared, heavy = shared_keys(rows, first)
    same = on_key(rows, shared, heavy).select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("l.node").alias("b"), F.col("l.size").alias("n"))
    firsts = checkpointed(rows.groupBy("key").agg(first))
    found = checkpointed(simhash.linked(firsts.select(F.col("key").alias("fp"))).distinct()).select("a", F.col("b").alias("key"))
    _, heavy = shared_keys(found)
    found = on_key(found, firsts, heavy).select(F.col("a").alias("key"), F.col("l").alias("lb"))
    _, heavy = shared_keys(found)
    found = on_key(found, firsts, heavy).select(F.col("l.node").alias("a"), F.col("l.size").alias("m"), F.col("lb.node").alias("b"), F.col("lb.size").alias("n"))
    return same.union(found).where(F.col("a") != F.col("b"))


def prefixes(held: DataFrame) -> DataFrame:
    """held: ROW, c, weight, hashes. Per shingle of each prefix that another text may have too: node, c, weight, size, key, its place (from 0), and MAP bits of the whole set (BITS)."""
    counted = held.select(F.explode("hashes").alias("h")).groupBy(F.col("h").bitwiseAND(CELLS - 1).alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    often = np.zeros(CELLS, np.int64)
    often[counted["cell"].to_numpy()] = counted["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(3).offsets.to_numpy()
            every = batch.column(3).values.to_numpy()
            sizes = np.diff(ends)
            counts = sizes - np.ceil(sizes * (SIMILAR - 1e-9)).astype(np.int64) + 1
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 20), "right")) - 1)
                h, owner = every[ends[a] : ends[b]], np.repeat(np.arange(a, b), sizes[a:b])
                cell = often[h & (CELLS - 1)]
                order = np.lexsort((h, cell, owner))
                place = np.arange(len(h)) - (ends[owner] - ends[a])
                first = (place < counts[owner]) & (cell[order] > 1)
                h, owner, place = h[order][first], owner[first], place[first]
                bits = np.zeros((b - a, MAP), bool)
                bits[np.repeat(np.arange(b - a), sizes[a:b]), every[ends[a] : ends[b]] >> 20 & MAP - 1] = True
                longs = np.packbits(bits, axis=1).view(np.int64)
                kept = [batch.column(i).take(pa.array(owner)) for i in range(3)]
                kept += [pa.array(sizes[owner], pa.int64()), pa.array(h), pa.array(place, pa.int64())]
                kept += [pa.array(longs[owner - a, w]) for w in range(MAP // 64)]
                yield pa.RecordBatch.from_arrays(kept, names=["node", "c", "weight", "size", "key", "place", *BITS])
                a = b

    columns = ["node", "c", "weight", "size", "key", "place", *BITS]
    return held.select(ROW, "c", "weight", "hashes").mapInArrow(run, ", ".join(f"{x} long" for x in columns))


def meeting(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes: node, c (its component); docs: ROW and hashes (or text), of these nodes at least. Pairs a, b of different components that may be similar, all that are among them."""
    held = docs if "hashes" in docs.columns else sets(docs)
    weights = nodes.groupBy("c").agg(F.count(F.lit(1)).alias("weight"))
    wanted = nodes.join(weights, "c").select(F.col("node").alias(ROW), "c", "weight")
    rows = checkpointed(prefixes(checkpointed(held.join(wanted, ROW))))
    group = F.struct("weight", "c")
    shared, heavy = shared_keys(rows, F.max(group).alias("largest"), F.min(group).alias("smallest"))
    parts = F.ceil(F.col("sharers") / BLOCK).cast("int")
    split = shared.where("largest <> smallest").select("key", F.col("largest.c").alias("largest"), parts.alias("parts"))
    met = on_key(rows, split, heavy)
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    one = met.where("c <> largest").select("key", part.alias("part"), F.col("node").alias("a"), group.alias("ga"), F.col("size").alias("m"), F.col("place").alias("i"), *(F.col(w).alias(f"a{w}") for w in BITS))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    two = met.select("key", every.alias("part"), F.col("node").alias("b"), group.alias("gb"), F.col("size").alias("n"), F.col("place").alias("j"), *(F.col(w).alias(f"b{w}") for w in BITS))
    enough = (F.col("m") + F.col("n")) * (SIMILAR / (1 + SIMILAR)) - 1e-6
    after = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= enough
    without = [total([F.bit_count(F.col(p + w).bitwiseAND(F.bitwise_not(F.col(q + w)))) for w in BITS]) for p, q in ("ab", "ba")]
    return one.join(two, ["key", "part"]).where((F.col("ga") < F.col("gb")) & after & (F.col("m") - without[0] >= enough) & (F.col("n") - without[1] >= enough)).select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """docs: ROW, doc_id, text. Per row ROW, doc_id, component (of its group the same for all)."""
    every = checkpointed(digested(docs))
    nodes = every.groupBy("h1", "h2").agg(F.min(ROW).alias("node"))
    texts = every.join(nodes.select("node"), every[ROW] == F.col("node"), "left_semi").select(F.col(ROW).alias("node"), "size", "fp", "keys")
    fits = F.least("m", "n") >= F.greatest("m", "n") * (SIMILAR - 1e-9)
    close = checkpointed(near(texts.select("node", "size", "fp")).where(fits))
    distinct = texts.select("node", "size", F.explode("keys").alias("key"))
    least = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("mixed"), "node", "size")) for i in range(LEADS)]
    shared, heavy = shared_keys(distinct, F.array(*least).alias("leads"))
    met = checkpointed(on_key(distinct, shared, heavy))
    some = met.select("node").union(close.select("a")).union(close.select("b")).distinct()
    held = checkpointed(sets(docs.select(ROW, "text").join(some.withColumnRenamed("node", ROW), ROW, "left_semi")))
    leads = F.when(F.col("sharers") > HOT, F.col("leads")).otherwise(F.slice("leads", 1, 1))
    led = met.select("node", F.col("size").alias("m"), F.explode(leads).alias("l")).select(F.col("node").alias("a"), "m", F.col("l.node").alias("b"), F.col("l.size").alias("n"))
    linked = verified(led.where((F.col("a") != F.col("b")) & fits).union(close).select("a", "b"), held)
    found = components(linked).withColumnRenamed("component", "c")
    placed = checkpointed(met.where("sharers > 2").join(found, "node", "left").select("key", "sharers", "node", "size", F.coalesce("c", "node").alias("c")))
    split = placed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
    apart = checkpointed(on_key(placed, split, heavy))
    cold = apart.where(F.col("sharers") <= HOT)
    one = cold.select("key", F.col("node").alias("a"), F.col("size").alias("m"), F.col("c").alias("ca"))
    two = cold.select("key", F.col("node").alias("b"), F.col("size").alias("n"), F.col("c").alias("cb"))
    more = one.join(two, "key").where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b")
    more = more.union(meeting(apart.where(F.col("sharers") > HOT).select("node", "c").distinct(), held))
    final = components(found.toDF("a", "b").union(verified(more, held))).withColumnRenamed("component", "c")
    by_text = nodes.join(final, "node", "left").select("h1", "h2", F.coalesce("c", "node").alias("component"))
    return every.select(ROW, "doc_id", "h1", "h2").join(by_text, ["h1", "h2"]).select(ROW, "doc_id", "component")
