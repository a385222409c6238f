"""Operator 5: bytes covered by a SIZE-byte string that starts in an earlier document too.

Strings are told apart by suffix sorting (induced.py): of the suffixes in one shard, those
with SIZE bytes in common are one string, and the least doc_id among them is the string's
first document. Shards hold text by content, so that equal strings meet however the
documents lie:

1. Every SIZE-byte string has one anchor, the least of its GRAM-byte strings by a hash
   (of equal ones the first). Consecutive strings with the same anchor are one context of
   at most 2 * SIZE - GRAM bytes. Equal strings have equal anchors, so a string that
   starts in two documents has an anchor that both have.
2. A first pass deals out the hashes of anchors, once for each batch of documents with the
   number of its different contexts: in order, as steps of some three bytes, a row for each
   batch and bucket of hashes. It finds the anchors of several documents, which go back in
   the same form; those of one document need nothing more. And it finds the hot ones, with
   over HOT contexts in all batches together.
3. The contexts of the others, once for each batch, go to shards by their anchor's hash.
   Around a hot anchor, such as a line that many documents have amid differing text, each
   string is a context of its own and goes by its own hash: equal strings still meet, and
   no anchor gives a shard more than HOT contexts. A shard sorts the suffixes of its
   distinct contexts and tells each batch the first document of each of their strings.
   Contexts that can't have a string in common with another one (akin()) need no sorting:
   their strings are the context's documents', whichever these are.
4. Each batch marks its documents' bytes and writes what is left.

Texts are shuffled once (by batch; both uses read the same shuffle); contexts and answers
go as compressed bytes, a row for each batch and shard. Batches collapse copies before
anything is dealt out: an anchor or context that a third of all documents have is an item
for each batch, not each document. A batch has 1 << BATCH documents, more in large tables
(batch_bits()), as small rows compress badly. There is a shard for each SHARD bytes of text.

Null and empty texts, and texts shorter than SIZE bytes, lose nothing. Very long texts are
worked on in pieces of PIECE bytes, but marked whole, in some 40 bytes of memory a byte.
Rows of the same doc_id don't take from each other, as neither is smaller; a null doc_id
is later than any other. Repeated rows get the same result each. An empty table gives an
empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import table, with_row_id
from tessel.llm.induced import DEPTH, suffixes

SIZE, GRAM = DEPTH, 16
SPAN = SIZE - GRAM
#: Documents of a batch, as a power of two, where the table is not large.
BATCH = 10
#: Bytes of text for each shard of contexts.
SHARD = 8 << 20
#: In tables with over SPREAD batches of documents, bytes of a batch on average.
LARGE, SPREAD = 16 << 20, 256
#: Bytes of text for each bucket of anchors' hashes.
BUCKET = 32 << 20
#: Contexts of one anchor, summed over batches, beyond which it's hot.
HOT = 4096
#: Bytes of text whose anchors are found at once, and whose bytes are marked at once.
PIECE, MARKED = 1 << 17, 1 << 20
LAST = (1 << 63) - 1
#: Bits of an anchor's hash that are dealt out.
BITS = 40
SHORT = (1 << BITS) - 1
P = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)]
#: In a byte with a context's size or a number of answers: it's one string of a hot anchor.
ALONE = 128


def contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each context the text it's in, the first string's place there, the number of strings, the anchor's hash, and the context's key."""
    out = []
    lot: list[bytes] = []
    of: list[int] = []
    at: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - SIZE + 1, PIECE):
            lot.append(t[a : a + PIECE + SIZE - 1])
            of.append(i)
            at.append(a)
            size += len(lot[-1])
            if size >= PIECE:
                out.append(lotted(lot, of, at))
                lot, of, at, size = [], [], [], 0
    if lot:
        out.append(lotted(lot, of, at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def grams(data: bytes) -> np.ndarray:
    """A hash of each GRAM-byte string."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = eight[:n] * P[0]
        h ^= h >> np.uint64(29)
        h += eight[8 : 8 + n] * P[1]
        h *= P[2]
        h ^= h >> np.uint64(32)
        h *= P[0]
    return h


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number and of its inverse."""
    n = 2 * PIECE + 4 * SIZE
    return np.cumprod(np.full(n, P[1])), np.cumprod(np.full(n, np.uint64(pow(int(P[1]), -1, 1 << 64))))


def summed(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """keys() of contexts from the hashes of their 16-byte strings."""
    up, down = powers()
    sums = np.append(np.uint64(0), np.cumsum(h * up[: len(h)]))
    return ((sums[first + n + SPAN] - sums[first]) * down[first]).view(np.int64)


def keys(data: bytes, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits for each context (ascending places, numbers of strings) that tell those of one batch apart: the sum of its strings' hashes, each times a power by its place in the context."""
    out = np.empty(len(first), np.int64)
    i = 0
    while i < len(first):
        a = int(first[i])
        j = int(np.searchsorted(first, a + PIECE, "right"))
        out[i:j] = summed(grams(data[a : int(first[j - 1] + n[j - 1]) + SIZE - 1]), first[i:j] - a, n[i:j])
        i = j
    return out


def lotted(lot: list[bytes], of: list[int], at: list[int]) -> tuple[np.ndarray, ...]:
    """contexts() of pieces of SIZE bytes or more, of texts of, that stand at at."""
    sizes = np.array([len(p) for p in lot])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    h = grams(b"".join(lot))
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    # the least of SPAN + 1 in a row, from those of 2, 4, ... in a row
    width = 1
    while 2 * width <= SPAN + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN + 1:
        low = np.minimum(low[: len(low) - (SPAN + 1 - width)], low[SPAN + 1 - width :])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.append(True, anchor[1:] != anchor[:-1])
    new[begins] = True
    new[ends[:-1] - SIZE + 1] = True  # from here strings would reach into the next piece
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(anchor)))
    piece = np.searchsorted(ends, first, "right")
    whole = first <= ends[piece] - SIZE
    first, n, piece = first[whole], n[whole], piece[whole]
    return np.array(of)[piece], first - begins[piece] + np.array(at)[piece], n, h[anchor[first]].view(np.int64), summed(h, first, n)


def numbers(docs: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """doc_ids as numbers, null as the last."""
    return docs.cast(pa.int64()).fill_null(LAST).to_numpy()


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after the other."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def planes(x: np.ndarray) -> bytes:
    """int64 with all first bytes first, then all second ones: ids of one batch differ in few of them."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(x: np.ndarray) -> np.ndarray:
    """planes() read as int64, in place again."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(8, -1).T).view("<i8").ravel()


def hashes_pressed(h: np.ndarray, *more: np.ndarray) -> bytes:
    """h: ascending hashes of anchors, as the steps between them, some three bytes each; and what else there is of each."""
    step = np.diff(h, prepend=0)
    return pressed(np.array([len(h)]), step.astype(np.uint16), (step >> 16).astype(np.uint8), (step >> 24).astype(np.uint16), *more)


def hashes_of(low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.cumsum(low.astype(np.int64) | middle.astype(np.int64) << 16 | high.astype(np.int64) << 24)


def anchored(rows: DataFrame, buckets: int = 1) -> DataFrame:
    """rows: batch, doc_id, text. For each batch and bucket of hashes (h): batch, data (pressed: SHORT bits of the hash of each anchor once, in order: one anchor mistaken for another is a context too many, no more; and 16 bits, from the right: whether several documents of the batch have it, the number of its contexts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(i << BITS) // buckets for i in range(buckets + 1)])
        for b in batches:
            ids, docs = b.column(0).to_numpy(), numbers(b.column(1))
            edges = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])).tolist() if len(ids) else []
            for begin, end in zip(edges, [*edges[1:], len(ids)], strict=True):
                of, _, _, h, key = contexts([(b.column(2)[i].as_py() or "").encode() for i in range(begin, end)])
                if not len(h):
                    continue
                h, doc = h & SHORT, docs[begin + of]
                order = np.argsort(h)
                h, key, doc = h[order], key[order], doc[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                n = np.diff(np.append(first, len(h)))
                again = np.flatnonzero(n > 1)  # of these only the different contexts count
                inner, which = ragged(first[again], n[again]), np.repeat(again, n[again])
                inner = inner[np.lexsort((key[inner], which))]
                n[again] = 1
                fresh = np.flatnonzero((which[1:] == which[:-1]) & (key[inner[1:]] != key[inner[:-1]]))
                n += np.bincount(which[1:][fresh], minlength=len(n))
                n = np.minimum(n, (1 << 15) - 1)
                h, counts = h[first], (n << 1 | several).astype(np.uint16)
                cut = np.searchsorted(h, bounds)
                some = np.flatnonzero(np.diff(cut))
                data = [hashes_pressed(h[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]]) for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), ids[begin], np.int64)), pa.array(data, pa.binary())], names=["h", "batch", "data"])

    return rows.mapInArrow(run, "h long, batch long, data binary")


def told(batch: list[int], data: list[bytes], most: int) -> pa.RecordBatch:
    """shared() of one bucket's rows; anchors with over most contexts are hot."""
    parts = [unpressed(d, "<u2", "u1", "<u2", "<u2") for d in data]
    each = [hashes_of(*p[:3]) for p in parts]
    ends = np.cumsum([len(h) for h in each])
    every, counts = np.concatenate(each), np.concatenate([p[3] for p in parts]).astype(np.int64)
    width = 63 - BITS
    if len(every) <= 1 << width:  # hash and place in one number, which is sorted much faster than places by hashes
        both = np.sort(every << width | np.arange(len(every)))
        h, place = both >> width, both & (1 << width) - 1
    else:
        place = np.argsort(every, kind="stable")
        h = every[place]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    n = np.diff(np.append(first, len(h)))
    heavy = np.add.reduceat(counts[place] >> 1, first) > most
    several = (n > 1) | (np.add.reduceat(counts[place] & 1, first) > 0) | heavy
    kind = np.empty(len(h), np.int8)
    kind[place] = np.repeat(several + heavy.astype(np.int8), n)
    out: list[list] = [[], [], []]
    for b, hashes, kinds in zip(batch, each, np.split(kind, ends[:-1]), strict=True):
        for hot in (False, True):
            mine = hashes[kinds == 1 + hot]
            if len(mine):
                for column, x in zip(out, (b, hashes_pressed(mine), hot), strict=True):
                    column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["batch", "part", "hot"])


def shared(anchors: DataFrame) -> DataFrame:
    """Of anchors in several documents: batch, part (hashes_pressed(), a row for the hot ones and one for the others of each row of anchors). A bucket's rows stand together; one bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, batch, data = None, [], []
        for b in batches:
            for x, y, z in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if x != bucket and data:
                    yield told(batch, data, HOT)
                    batch, data = [], []
                bucket = x
                batch.append(y)
                data.append(z)
        if data:
            yield told(batch, data, HOT)

    return anchors.repartition("h").sortWithinPartitions("h").mapInArrow(run, "batch long, part binary, hot boolean")


def parts_of(wanted: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """wanted: shared(), or part as a number of 32 bits. Each anchor once, ascending, and whether it's hot."""
    part, hot = wanted.column("part"), wanted.column("hot").to_numpy()
    if pa.types.is_binary(part.type):
        each = [hashes_of(*unpressed(d.as_py(), "<u2", "u1", "<u2")[:3]) for d in part]
        known, hot = np.concatenate([np.zeros(0, np.int64), *each]), np.repeat(hot, [len(x) for x in each])
    else:
        known = part.to_numpy()
    if not len(known):
        return known, hot
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    first = np.flatnonzero(np.append(True, known[1:] != known[:-1]))
    return known[first], np.logical_or.reduceat(hot, first)  # of equal parts it's hot if any is


def packed(rows: DataFrame) -> DataFrame:
    """rows: batch, row, doc_id, text, with text as compressed bytes: texts are most of what is shuffled."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data = [press.compress((t.as_py() or "").encode()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(data, pa.binary())], names=["batch", "row", "doc_id", "data"])

    return rows.mapInArrow(run, f"batch long, row long, doc_id {kind}, data binary")


def lots(docs: pa.Table) -> Iterator[tuple[int, list[bytes], bytes, np.ndarray]]:
    """docs: packed(). Some documents at a time, of about MARKED bytes: which is the first, their texts, these joined, and where each begins there."""
    press = zstandard.ZstdDecompressor()
    part: list[bytes] = []
    size = 0
    data = docs.column("data")
    for i in range(len(data)):
        part.append(press.decompress(data[i].as_py()))
        size += len(part[-1])
        if size >= MARKED or i == len(data) - 1:
            sizes = np.array([len(t) for t in part])
            yield i + 1 - len(part), part, b"".join(part), np.cumsum(sizes) - sizes
            part, size = [], 0


def matches(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of asked are in known (ascending), and where there."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    hit = np.flatnonzero(known[at] == asked)
    return hit, at[hit]


def pressed(*parts: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts))


def unpressed(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of pressed(): the first is one number, which is the length of the others but the last."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out, at = [], 8
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(data, np.uint8, -1, at)]


def alone(joined: bytes, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each string of contexts: its place and its key."""
    place = ragged(at, n)
    return place, keys(joined, place, np.ones(len(place), np.int64))


def gathered(docs: pa.Table, wanted: pa.Table, shards: int) -> pa.Table:
    """docs: packed(), of one batch; wanted: its shared anchors. Each distinct context once: shard, batch, and (pressed) low and more (the least doc_id; with more added: the greatest), size, bytes."""
    known, hot = parts_of(wanted)
    doc_ids = numbers(docs.column("doc_id"))
    found: dict[int, bytes] = {}
    parts = [(np.zeros(0, np.int64),) * 3]
    for begin, texts, joined, base in lots(docs) if len(known) else ():
        of, at, n, h, key = contexts(texts)
        hit, place = matches(known, h & SHORT if known.dtype == np.int64 else h.astype(np.int32))
        of, at, n, h, key, single = of[hit], (base[of] + at)[hit], n[hit], h[hit], key[hit], hot[place]
        at_one, key_one = alone(joined, at[single], n[single])
        deal = np.append(h[~single], key_one) % shards
        doc = doc_ids[begin + np.append(of[~single], np.repeat(of[single], n[single]))]
        at, size, key = np.append(at[~single], at_one), np.append(n[~single] + SIZE - 1, np.full(len(at_one), SIZE)), np.append(key[~single], key_one)
        mark = np.append(np.zeros(int((~single).sum()), np.int64), np.full(len(at_one), ALONE))
        parts.append((key, doc, deal << 8 | mark | size))
        for k, a, b in zip(*(x[np.unique(key, return_index=True)[1]].tolist() for x in (key, at, at + size)), strict=True):
            if k not in found:
                found[k] = joined[a:b]
    key, doc, deal = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((key, deal))
    key, doc, deal = key[order], doc[order], deal[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    low, high = (f.reduceat(doc, first) if len(first) else first for f in (np.minimum, np.maximum))
    key, deal = key[first], deal[first]
    shard, size = deal >> 8, (deal & 255).astype(np.uint8)
    out: list[list] = [[], []]
    edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() if len(shard) else []
    names = key.tolist()
    for a, b in zip(edges, [*edges[1:], len(shard)], strict=True):
        out[0].append(int(shard[a]))
        out[1].append(pressed(np.array([b - a]), planes(low[a:b]), planes(high[a:b] - low[a:b]), size[a:b], b"".join([found[k] for k in names[a:b]])))
    batch = docs.column("batch")[0].as_py() if docs.num_rows else 0
    return pa.table([pa.array(out[0], pa.int64()), pa.array([batch] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary())], names=["shard", "batch", "data"])


def binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """An array of byte strings of these sizes, one after the other in data."""
    ends = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def akin(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of different contexts, one after the other in text, those that may have a string in common with another one. Of a string's other bytes half or more stand on one side of its anchor, so both contexts have the anchor with as many bytes on that side; what is equal there is told by hashes, and a chance match is a context too many."""
    h = grams(text.tobytes())
    anchor = begins + (h[begins[:, None] + np.arange(SPAN + 1)] >> np.uint64(24)).argmin(1)
    half = SPAN // 2
    found = np.zeros(len(begins), bool)
    for first, whole in ((anchor - half, anchor - half >= begins), (anchor, anchor + GRAM + half <= begins + sizes)):
        with np.errstate(over="ignore"):
            side = h[first[whole]] * P[1] ^ h[first[whole] + half] * P[2]
        order = np.argsort(side)
        same = side[order[1:]] == side[order[:-1]]
        found[np.flatnonzero(whole)[order[np.append(same, False) | np.append(False, same)]]] = True
    return np.flatnonzero(found)


def told_apart(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in text, by suffix sorting. Of each place of all of them, with a byte after each, the first document of the string that begins there, for other places LAST, and the same with -1; and where each context begins."""
    ends = np.cumsum(sizes + 1) - 1
    at = ends - sizes
    data = np.zeros(int(sizes.sum()) + len(sizes), np.uint8)  # 0, at each context's end, is below every byte
    data[ragged(at, sizes)] = text[ragged(begins, sizes)] + np.uint8(1)  # UTF-8 has no byte 255
    place, common = suffixes(data)
    starts = np.ones(len(data), bool)  # where SIZE bytes stand
    for i in range(SIZE):
        starts[ends - i] = False
    group = np.cumsum(common < SIZE)
    whole = np.flatnonzero(starts[place])
    place, group = place[whole], group[whole]
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(np.repeat(low, sizes + 1)[place], edge), np.diff(np.append(edge, len(group))))
    first, begun = np.full(len(data), LAST), np.full(len(data), -1)
    first[place] = least
    begun[place] = least
    return first, begun, at


def resolved(shard: pa.Table) -> pa.Table:
    """A shard's contexts as batches have them. For each batch that may lose bytes: batch, and (pressed) of each such context the key (a hash of it), how many answers, the anchor's part if it's one string of a hot one, else 0; and the answers: each string's first document; one number if it's the same for all."""
    blobs = [unpressed(d.as_py(), "<i8", "<i8", "u1") for d in shard.column("data")]
    low_of, more, size, flat = (np.concatenate(x) for x in zip(*((unplaned(a), unplaned(b), c, d) for a, b, c, d in blobs), strict=True))
    batch = np.repeat(shard.column("batch").to_numpy(), [len(b[0]) for b in blobs])
    single, size = size >= ALONE, (size & (ALONE - 1)).astype(np.int64)
    coded = binaries(size, flat).dictionary_encode()
    index, distinct = coded.indices.to_numpy(), coded.dictionary
    count = len(distinct)
    low, mark = np.full(count, LAST), np.zeros(count, bool)
    np.minimum.at(low, index, low_of)
    mark[index] = single
    sizes = np.diff(np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + count + 1])
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(distinct.buffers()[2], np.uint8)[: int(sizes.sum())]
    lowest, highest, source, asked = low.copy(), low.copy(), low, np.arange(count)  # of a context, and where the answers of each begin
    sort = akin(text, begins, sizes)
    if len(sort):
        first, begun, at = told_apart(text, begins[sort], sizes[sort], low[sort])
        lowest[sort], highest[sort] = np.minimum.reduceat(first, at), np.maximum.reduceat(begun, at)
        source, asked[sort] = np.append(low, first), count + at
    losing = np.flatnonzero(lowest[index] < low_of + more)
    batch, index = batch[losing], index[losing]
    some, index = np.unique(index, return_inverse=True)
    text = text.tobytes()
    strings = sizes[some] - SIZE + 1
    key = keys(text, begins[some], strings)
    part = np.zeros(len(some), np.int32)
    hot = np.flatnonzero(mark[some])
    if len(hot):
        part[hot] = contexts([text[a : a + SIZE] for a in begins[some[hot]].tolist()])[3].astype(np.int32)
    n = np.where(lowest[some] == highest[some], 1, strings)
    answers, begin = source[ragged(asked[some], n)], np.cumsum(n) - n
    order = np.argsort(batch, kind="stable")
    batch, index = batch[order], index[order]
    edges = np.flatnonzero(np.append(True, batch[1:] != batch[:-1])).tolist() if len(batch) else []
    out: list[list] = [[], []]
    for a, b in zip(edges, [*edges[1:], len(batch)], strict=True):
        i = index[a:b]
        out[0].append(int(batch[a]))
        out[1].append(pressed(np.array([b - a]), key[i], part[i], (n[i] | ALONE * mark[some[i]]).astype(np.uint8), planes(answers[ragged(begin[i], n[i])])))
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["batch", "data"])


class Answers:
    """resolved() for one batch."""

    def __init__(self, found: pa.Table):
        parts = [unpressed(d.as_py(), "<i8", "<i4", "u1") for d in found.column("data")]
        parts.append([np.zeros(0, k) for k in ("<i8", "<i4", "u1", "u1")])
        key, part, n, self.firsts = (np.concatenate(x) for x in zip(*((k, p, n, unplaned(f)) for k, p, n, f in parts), strict=True))
        self.hot = np.unique(part[n >= ALONE])
        n = (n & (ALONE - 1)).astype(np.int64)
        begin = np.cumsum(n) - n
        self.known, one = np.unique(key, return_index=True)
        self.n, self.begin = n[one], begin[one]

    def marked(self, texts: list[bytes], joined: bytes, base: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which bytes of joined texts go."""
        of, at, n, h, key = contexts(texts)
        at = base[of] + at
        single = matches(self.hot, h.astype(np.int32))[0]
        at_one, key_one = alone(joined, at[single], n[single])
        of_one = np.repeat(of[single], n[single])
        of, at, n, key = np.append(of, of_one), np.append(at, at_one), np.append(n, np.ones(len(at_one), np.int64)), np.append(key, key_one)
        hit, place = matches(self.known, key)
        of, at, n, begin, answers = of[hit], at[hit], n[hit], self.begin[place], self.n[place]
        every = (answers == 1) & (n > 1)  # one answer for all strings
        begins, ends = [], []
        gone = self.firsts[begin[every]] < doc[of[every]]
        begins.append(at[every][gone])
        ends.append((at + n + SIZE - 1)[every][gone])
        of, at, n, begin = of[~every], at[~every], n[~every], begin[~every]
        gone = self.firsts[ragged(begin, n)] < np.repeat(doc[of], n)
        begins.append(ragged(at, n)[gone])
        ends.append(begins[-1] + SIZE)
        change = np.bincount(np.concatenate(begins), minlength=len(joined) + 1) - np.bincount(np.concatenate(ends), minlength=len(joined) + 1)
        return np.cumsum(change)[:-1] > 0


def cleaned(docs: pa.Table, found: pa.Table) -> pa.Table:
    """docs: packed(); found: resolved(). Per document: doc_id, n_bytes, n_removed, n_spans, kept."""
    answers, doc_ids = Answers(found), numbers(docs.column("doc_id"))
    out: list[list] = [[], [], [], []]
    for begin, texts, joined, base in lots(docs):
        gone = answers.marked(texts, joined, base, doc_ids[begin : begin + len(texts)])
        ends = np.append(base[1:], len(joined))
        fresh = gone.copy()  # the first byte of a run
        fresh[1:] &= ~gone[:-1]
        inner = base[base < len(joined)]
        fresh[inner] = gone[inner]
        sums = [np.append(0, np.cumsum(x, dtype=np.int64)) for x in (gone, fresh)]
        removed, spans = (x[ends] - x[base] for x in sums)
        out[0].append(pa.array(ends - base))
        out[1].append(pa.array(removed))
        out[2].append(pa.array(spans))
        out[3].append(binaries(ends - base - removed, np.frombuffer(joined, np.uint8)[~gone]).cast(pa.binary()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([docs.column("doc_id"), *(pa.chunked_array(o, k) for o, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def batch_bits(count: int, size: int) -> int:
    """Documents of a batch, as a power of two: more than BATCH in large tables, up to LARGE bytes on average, as contexts go in a row for each batch and shard, and many small rows compress badly."""
    bits = BATCH
    while size > SPREAD * LARGE >> 1 and (size << bits + 1) <= count * LARGE and (size << bits + 1) <= count * size // SPREAD:
        bits += 1
    return bits


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    count, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = with_row_id(docs.select("doc_id", "text"), "row").select(F.shiftright("row", batch_bits(count, size)).alias("batch"), "row", "doc_id", "text")
    wanted = shared(anchored(rows.select("batch", "doc_id", "text"), 1 + size // BUCKET))
    rows = packed(rows)
    gather = partial(gathered, shards=1 + size // SHARD)
    each = rows.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(lambda a, b: gather(a, b), "shard long, batch long, data binary")
    found = each.groupBy("shard").applyInArrow(resolved, "batch long, data binary")
    return rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(cleaned, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def brute(rows: list[tuple[int | None, str | None]], size: int = SIZE) -> list[tuple]:
    """What op5 should return for rows, all of them at once; for tests."""
    first: dict[bytes, int] = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - size + 1):
            s = data[i : i + size]
            first[s] = min(first.get(s, LAST), LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if first[data[i : i + size]] < (LAST if doc is None else doc):
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, sha256(kept).hexdigest()))
    return out
