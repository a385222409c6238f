"""Operator 10: substring dedup by sliding spans of sentences.

A sentence ends at . ! or ? before white space, or at a line's end; one longer than
LONG = 12 words counts as several, so that a long passage of few sentences still has
several units. It is cut where its words say so, after each whose hash is the least of
those up to NEAR = 3 words before and after (of equal ones the first), so that units fall
into step whatever stands before a passage; what is still longer than 12 words is cut
every 12 from its start. From each unit on, the span is the shortest run of
UNITS = 3 units or more that has WORDS = 20 words or more: it follows from the units
alone, so equal passages have equal spans wherever they stand, and no span is so short
that unrelated texts share it by chance. Words are runs without ASCII white space, compared
with A-Z in lower case; white space is not compared.

Every span is hashed (128 bits), and every unit covered by a span that isn't first goes;
the first place is that of the least doc_id (null last), row and position. A batch of
rows tells its own: its least place of each span goes on to the global join, the others are
lost already and go on as stretches of units. So a span that a third of all documents have
is a row for each batch there, not for each document. The global join is one shuffle by
hash, sorted by Spark (which spills), and one pass over what stands in a row.

Null and empty texts have no units. Texts with fewer words than a span have none. Very
long texts are worked on whole, one at a time; memory is about 100 bytes a byte of the
longest. Repeated rows are places like any others, so all but the first row lose what they
share. Further columns, whatever their names, are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import table, with_row_id

UNITS, WORDS, LONG, NEAR = 3, 20, 12, 3
#: Bytes of text worked on at once.
AT_ONCE = 1 << 17
ROW = "row of the table"
LAST = (1 << 63) - 1
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
LOWER = np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))
#: What a byte counts for in a word's hash, odd numbers for powers and mixing, and what a unit's first word adds.
BYTE = np.random.default_rng(10).integers(0, 1 << 63, 256).astype(np.uint64)[LOWER]
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
FIRST = np.uint64(0x165667B19E3779F9)


@cache
def powers(odd: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for x in (odd, pow(odd, -1, 1 << 64)):
        p = np.full(1 << bits, np.uint64(x))
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def sums(values: np.ndarray, odd: np.uint64, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each range of values the sum of value times odd ^ (its place in the range), modulo 2^64."""
    up, down = powers(int(odd), len(values).bit_length())
    total = np.append(np.uint64(0), np.cumsum(values * up[: len(values)]))
    return (total[end] - total[begin]) * down[begin]


def mixed(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * odd
    return h ^ (h >> np.uint64(32))


class Units:
    """Of texts: for each unit the text it's in (text) and the byte where it begins there (at), its first word (word), and for each text its first unit (first); each with one more at the end."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))  # by turns a word's begin and its end
        begin, end = edge[0::2], edge[1::2]
        n = len(begin)
        with np.errstate(over="ignore"):
            self.hash = mixed(sums(BYTE[data], ODD[0], begin, end), ODD[1])
        lines = np.searchsorted(np.flatnonzero(data == 10), begin)
        new = np.ones(n, bool)
        new[1:] = STOP[data[end[:-1] - 1]] | (lines[1:] != lines[:-1])
        sentence = np.cumsum(new) - 1
        low = np.bincount(sentence, minlength=1)[sentence] > LONG
        for k in range(1, NEAR + 1):
            apart = sentence[k:] != sentence[:-k]
            low[:-k] &= apart | (self.hash[:-k] <= self.hash[k:])
            low[k:] &= apart | (self.hash[k:] < self.hash[:-k])
        new[1:] |= low[:-1]
        place = np.arange(n)
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % LONG == 0
        word = np.flatnonzero(new)
        self.new = new
        self.word = np.append(word, n)
        self.text = np.searchsorted(begins, begin[word], "right") - 1
        self.at = begin[word] - begins[self.text]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each span its first unit, the unit after its last, and two hashes."""
        begin = np.arange(len(self.text))
        end = np.maximum(np.searchsorted(self.word, self.word[:-1] + WORDS), begin + UNITS)
        whole = np.flatnonzero(end <= self.first[self.text + 1])
        begin, end = begin[whole], end[whole]
        a, b = self.word[begin], self.word[end]
        with np.errstate(over="ignore"):
            h = self.hash + FIRST * self.new.astype(np.uint64)
            one, two = (mixed(sums(mixed(h, y), x, a, b), z) for x, y, z in (ODD, ODD[::-1]))
        return begin, end, one.view(np.int64), two.view(np.int64)


def parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Where to cut texts so that each part has about AT_ONCE bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE or i == len(texts) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def merged(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (of a text, units begin to end) with those that touch as one."""
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    if len(text):
        shift = text * (int(end.max()) + 1)  # so that no stretch reaches into another text
        reach = np.maximum.accumulate(end + shift)
        first = np.flatnonzero(np.append(True, (begin + shift)[1:] > reach[:-1]))
        end = np.maximum.reduceat(end, first)
        text, begin = text[first], begin[first]
    return text, begin, end


def spanned(docs: DataFrame) -> DataFrame:
    """docs: ROW, doc_id, text. Per span and batch its least place; and (lost) stretches of units that others of the batch cover. deal: the hash that spans meet on; lost ones are dealt by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            found: list[list[np.ndarray]] = []
            for a, b in parts(texts):
                units = Units(texts[a:b])
                begin, end, one, two = units.spans()
                mine = units.text[begin]
                found.append([mine + a, begin - units.first[mine], end - units.first[mine], one, two])
            if not found:
                continue
            text, begin, end, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
            row = batch.column(0).to_numpy()
            doc = batch.column(1).fill_null(LAST).to_numpy()
            rank = np.empty(len(texts), np.int64)
            rank[np.lexsort((row, doc))] = np.arange(len(texts))
            order = np.lexsort((begin, rank[text], two, one))
            text, begin, end, one, two = (x[order] for x in (text, begin, end, one, two))
            again = np.append(False, (one[1:] == one[:-1]) & (two[1:] == two[:-1])) if len(one) else np.zeros(0, bool)
            lost = merged(text[again], begin[again], end[again])
            text, begin, end, one, two = (x[~again] for x in (text, begin, end, one, two))
            order = np.argsort(text, kind="stable")  # a document's rows compress well side by side
            text, begin, end, one, two = (x[order] for x in (text, begin, end, one, two))
            n = len(lost[0])
            columns = [np.append(one, mixed(row[lost[0]].astype(np.uint64), ODD[2]).view(np.int64)), np.append(np.zeros(len(one), bool), np.ones(n, bool)), np.append(two, np.zeros(n, np.int64))]
            text, begin, end = np.append(text, lost[0]), np.append(begin, lost[1]), np.append(end, lost[2])
            columns += [doc[text], row[text], begin.astype(np.int32), (end - begin).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["deal", "lost", "h", "doc_id", ROW, "unit", "n"])

    return docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"deal long, lost boolean, h long, doc_id long, `{ROW}` long, unit int, n int")


def repeated(docs: DataFrame) -> DataFrame:
    """docs: ROW, doc_id, text. Per row that loses any unit: ROW, cuts (the stretches that go, as first unit and number)."""
    place = ["doc_id", ROW, "unit"]
    dealt = spanned(docs).repartition("deal").sortWithinPartitions("deal", "lost", "h", *place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            deal, lost, h = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            again = np.append(False, (deal[1:] == deal[:-1]) & (h[1:] == h[:-1]) & ~lost[:-1])
            again[0] = before == (deal[0], h[0])
            before = None if lost[-1] else (deal[-1], h[-1])
            gone = pa.array(np.flatnonzero(again | lost))
            yield pa.RecordBatch.from_arrays([b.column(i).take(gone) for i in (4, 5, 6)], names=[ROW, "unit", "n"])

    later = dealt.mapInArrow(run, f"`{ROW}` long, unit int, n int")
    return later.groupBy(ROW).agg(F.collect_list(F.struct("unit", "n")).alias("cuts"))  # no more than a document has units


def cut(text: bytes, cuts: list[dict]) -> tuple[int, int, list[tuple[int, int]]]:
    """How many units text has, how many go, and the stretches of bytes that go, end exclusive."""
    units = Units([text])
    n = len(units.text)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, [c["unit"] for c in cuts], 1)
    np.add.at(change, [c["unit"] + c["n"] for c in cuts], -1)
    gone = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    at = np.append(units.at, len(text))
    return n, int(gone.sum()), [(int(at[a]), int(at[b])) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row of docs that loses any unit: doc_id, n_sentences, n_removed, removed (begin:end in code points, comma-joined), kept (the text left)."""
    rows = with_row_id(docs.select("doc_id", "text"), ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, cuts in zip(batch.column(1), batch.column(2), strict=True):
                t = text.as_py().encode()
                n, gone, stretches = cut(t, cuts.as_py())
                edges = [0, *(x for s in stretches for x in s), len(t)]
                kept = [t[a:b].decode() for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                at = 0
                told = []
                for piece, (a, b) in zip(kept, stretches, strict=False):
                    at += len(piece)
                    size = len(t[a:b].decode())
                    told.append(f"{at}:{at + size}")
                    at += size
                for o, x in zip(out, (n, gone, ",".join(told), "".join(kept)), strict=True):
                    o.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=["doc_id", "n_sentences", "n_removed", "removed", "kept"])

    joined = rows.join(repeated(rows), ROW).select("doc_id", "text", "cuts")
    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_sentences long, n_removed long, removed string, kept string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
