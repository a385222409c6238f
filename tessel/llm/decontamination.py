"""Operator 2: benchmark decontamination by CGK embedding and bit-sampling LSH.

Symbols are words: lower-cased runs of letters and digits; punctuation and white space
are not compared. An item of n words leaks into a text when some stretch of the text is
within k = floor(n * (1 - SIMILARITY)) word edits of it.

The CGK embedding walks along a sequence for 3n steps: each step writes the word at hand
and goes on to the next one or not, as a random bit of step and word says. Sequences of
small edit distance so get embeddings of small Hamming distance. Windows as long as an
item are embedded by walks that all windows share; each of REPEATS repetitions has a walk
of its own and hashes BITS sampled places of it, and windows that share a hash with an
item are candidates. If each of the 3n places agrees with probability p, one window misses
with (1 - p^BITS)^REPEATS, and windows that begin a few words off are tried as well: of
400 items with exactly k random edits all were found. Candidates are then held against the
item by exact edit distance (bit-parallel, anywhere in the window and k words to either
side).

Which windows are embedded: k edits leave one of k + 1 equal pieces of an item whole, so a
window without any run of `seed` words of an item in a row, seed being the length of the
shortest such piece, can't be within k edits. Only windows around such runs are embedded,
whatever item the run is of; nothing is lost.

Items are sent to the executors in blocks of at most ITEM_BYTES of text; a larger
benchmark is several blocks, with a pass over the texts for each. Texts stay where they
are: no shuffle, and a lost task is done again from its rows.

Null and empty texts have no leaks, null and empty items (no words) leak nowhere. Repeated
items are items each; repeated rows each get their own result. doc_id may be null. An empty
table gives an empty result, an empty benchmark too. Further columns are ignored by
leaks() and kept by cleaned().
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import table

SIMILARITY = 0.9
REPEATS, BITS, SEED = 24, 6, 11
#: The text of items that one pass has.
ITEM_BYTES = 32 << 20
TOKEN = re.compile(r"[^\W_]+")


def edits(n: int, similarity: float = SIMILARITY) -> int:
    return int(n * (1 - similarity) + 1e-9)


class Index:
    """The items of one block, ready to be looked for. Words are numbers from 1; 0 is any word that no item has."""

    def __init__(self, items: list[tuple[int, str]]):
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        for item_id, text in items:
            tokens = TOKEN.findall((text or "").lower())
            if tokens:
                self.items.append((item_id, np.array([self.numbers.setdefault(t, len(self.numbers) + 1) for t in tokens]), edits(len(tokens))))
        self.seed = min((len(w) // (k + 1) for _, w, k in self.items), default=1)
        self.longest = max((len(w) + k for _, w, k in self.items), default=0)
        self.powers = np.random.default_rng(SEED).integers(1, 1 << 62, self.seed, dtype=np.int64) | 1
        by_length = defaultdict(list)
        for i, (_, w, _) in enumerate(self.items):
            by_length[len(w)].append(i)
        self.seeds = {n: np.unique(np.concatenate([self.runs(self.items[i][1]) for i in members])) for n, members in by_length.items()}
        self.maybe = np.zeros(1 << 20, bool)
        for found in self.seeds.values():
            self.maybe[found >> 13 & 0xFFFFF] = True
        draw = np.random.default_rng(SEED + 1)
        self.salts = draw.integers(1, 1 << 62, (REPEATS, 3 * max(self.longest, 1)), dtype=np.int64)
        self.places = {n: np.sort(draw.integers(0, 3 * n, (REPEATS, BITS)), axis=1) for n in sorted(by_length)}
        self.buckets: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(REPEATS)]
        for n, members in by_length.items():
            data = np.concatenate([np.append(self.items[i][1], 0) for i in members])
            starts = {n: np.arange(len(members)) * (n + 1)}
            for r in range(REPEATS):
                h = self.hashes(data, starts, r)[n]
                order = np.argsort(h, kind="stable")
                self.buckets[r][n] = h[order], np.array(members)[order]

    def runs(self, w: np.ndarray) -> np.ndarray:
        """A hash of each run of `seed` words."""
        n = len(w) - self.seed + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            return sum((w[i : i + n] * self.powers[i] for i in range(self.seed)), np.zeros(n, np.int64))

    def hashes(self, data: np.ndarray, starts: dict[int, np.ndarray], r: int) -> dict[int, np.ndarray]:
        """For each length, of the windows at starts the hash of repetition r: the words at the sampled places of its walk."""
        every = np.unique(np.concatenate(list(starts.values())))
        mine = {n: np.searchsorted(every, s) for n, s in starts.items()}
        out = {n: np.zeros(len(s), np.int64) for n, s in starts.items()}
        wanted: dict[int, list[int]] = defaultdict(list)
        for n in starts:
            for step in self.places[n][r].tolist():
                wanted[step].append(n)
        at = every.copy()
        last = len(data) - 1
        with np.errstate(over="ignore"):
            for step in range(max(wanted) + 1):
                word = data[np.minimum(at, last)]
                for n in wanted.get(step, ()):
                    i = mine[n]
                    seen = np.where(at[i] - every[i] < n, word[i], -1)
                    out[n] = (out[n] * 1_000_003) ^ (seen * 0x9E3779B1 + 7)
                turn = (word + 1) * self.salts[r, step]
                at += ((turn ^ (turn >> 31)) >> 17) & 1
        return out

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """Text, item, edits, and where the stretch begins and ends in words of text; the best of each text and item."""
        if not self.items:
            return []
        near: dict[int, list[np.ndarray]] = defaultdict(list)
        parts: list[np.ndarray] = []
        begins: list[int] = []
        sizes: list[int] = []
        owners: list[int] = []
        at = 0
        for t, text in enumerate(texts):
            get = self.numbers.get
            w = np.array([get(x, 0) for x in TOKEN.findall(text.lower())], np.int64)
            runs = self.runs(w)
            hit = np.flatnonzero(self.maybe[runs >> 13 & 0xFFFFF])
            if not len(hit):
                continue
            any_start = False
            for n, seeds in self.seeds.items():
                own = hit[seeds[np.minimum(np.searchsorted(seeds, runs[hit]), len(seeds) - 1)] == runs[hit]]
                if not len(own):
                    continue
                k = edits(n)
                mark = np.zeros(len(w) + 1, np.int64)
                np.add.at(mark, np.maximum(0, own + self.seed - n - k), 1)
                np.add.at(mark, np.minimum(len(w), own + k + 1), -1)
                near[n].append(np.flatnonzero(np.cumsum(mark)[:-1] > 0) + at)
                any_start = True
            if any_start:
                parts += [w, np.zeros(self.longest, np.int64)]
                begins.append(at)
                sizes.append(len(w))
                owners.append(t)
                at += len(w) + self.longest
        if not near:
            return []
        data = np.concatenate(parts)
        starts = {n: np.concatenate(s) for n, s in near.items()}
        tried = np.zeros(0, np.int64)
        for r in range(REPEATS):
            codes = [tried]
            for n, h in self.hashes(data, starts, r).items():
                known, members = self.buckets[r][n]
                low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
                count = high - low
                which = np.repeat(np.arange(len(h)), count)
                item = members[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]]
                codes.append(item * (len(data) + 1) + starts[n][which])
            tried = np.unique(np.concatenate(codes))
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for code in tried.tolist():
            i, s = divmod(code, len(data) + 1)
            d = int(np.searchsorted(begins, s, "right")) - 1
            self.verify(data[begins[d] : begins[d] + sizes[d]], s - begins[d], i, (owners[d], i), found)
        return [(t, self.items[i][0], *f) for (t, i), f in sorted(found.items())]

    def verify(self, w: np.ndarray, start: int, i: int, key: tuple[int, int], found: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Holds item i against what w has around start, and keeps the best by key."""
        _, item, k = self.items[i]
        if key in found and found[key][0] == 0:
            return
        a, b = max(0, start - k), min(len(w), start + len(item) + k)
        least, end = nearest(item.tolist(), w[a:b].tolist())
        if least <= k and (key not in found or (least, a + end) < (found[key][0], found[key][2])):
            _, length = nearest(item.tolist()[::-1], w[a : a + end].tolist()[::-1])
            found[key] = (least, a + end - length, a + end)


def nearest(item: list[int], words: list[int]) -> tuple[int, int]:
    """The least edit distance of item to any stretch of words, and where the first such stretch ends (Myers' bit vectors)."""
    n = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, x in enumerate(item):
        masks[x] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, x in enumerate(words):
        eq = masks.get(x, 0) if x else 0
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def blocks(benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> Iterator[Index]:
    """The benchmark, as many indexes as keep each one's text within item_bytes or so."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = 1 + 2 * size // item_bytes
    for i in range(count):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i) if count > 1 else benchmark
        yield Index([(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per text and item that leaks into it: doc_id, item_id, edits, begin, end (words of the text, end exclusive)."""
    slim = docs.select("doc_id", "text")
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, edits int, begin int, end int"
    out = None
    for index in blocks(benchmark, item_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = index.leaks([t.as_py() or "" for t in batch.column(1)])
                columns = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found])]
                columns += [pa.array([f[j] for f in found], pa.int32()) for j in (2, 3, 4)]
                if found:
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "edits", "begin", "end"])

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs without the texts that any item leaks into."""
    at = docs.columns.index("text")
    for index in blocks(benchmark, item_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaking = {f[0] for f in index.leaks([t.as_py() or "" for t in batch.column(at)])}
                yield batch.filter(pa.array([i not in leaking for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned(docs, table(spark, sf_dir, "benchmark"))
