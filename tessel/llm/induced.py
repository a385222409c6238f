"""Suffix sorting by induction, with queues that spill to disk, in numpy.

A suffix is S-type if it is smaller than the one after it, else L-type; the leftmost
S-types of each run (LMS) are sorted first, and all others follow: scanned in ascending
order, a suffix puts the L-type before it at the end of its symbol's bucket; scanned in
descending order, the S-type before it. So items leave in the order of (symbol, arrival),
and a priority queue is a queue for each symbol. An item carries its place and how much it
has in common with the item before it (up to DEPTH symbols): one more than the least of
such values between the two items that induced them.

Items of a bucket that none of the same bucket induced are independent of each other, so a
bucket is worked through in generations, each at once. Queues hold HELD bytes in memory
and put older items into a temporary file that goes with the task.

LMS suffixes are named by their substrings up to the next LMS, which a first induction
from unsorted ones sorts (it carries no common values, as nothing would use them), and the
string of names is sorted in turn: names have no small alphabet, so there doubling takes
the part of induction, until names are unique or cover DEPTH symbols (order beyond is of no
account here).
"""

from __future__ import annotations

import tempfile

import numpy as np

DEPTH = 50
#: Bytes of queued items held in memory.
HELD = 64 << 20


class Queues:
    """A first-in first-out queue of (place, common) for each symbol."""

    def __init__(self, held: int = HELD):
        self.parts: dict[int, list] = {}
        self.held, self.size, self.file = held, 0, None

    def push(self, symbol: int, place: np.ndarray, common: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((place, common))
        self.size += place.nbytes + common.nbytes
        if self.size > self.held:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if len(part) == 2:
                    parts[i] = (self.file.tell(), len(part[0]), part[0].dtype)
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
        self.size = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that the symbol's queue holds now."""
        parts = self.parts.pop(symbol, None)
        if not parts:
            return None
        out = []
        for part in parts:
            if len(part) == 3:
                self.file.seek(part[0])
                out.append((np.frombuffer(self.file.read(part[1] * part[2].itemsize), part[2]), np.frombuffer(self.file.read(part[1]), np.uint8)))
            else:
                self.size -= part[0].nbytes + part[1].nbytes
                out.append(part)
        return out[0] if len(out) == 1 else (np.concatenate([p for p, _ in out]), np.concatenate([c for _, c in out]))


class Least:
    """Least values of ranges of an array of bytes."""

    def __init__(self, values: np.ndarray):
        levels, width = [values], 1
        while 2 * width <= len(values):
            low = levels[-1].copy()
            np.minimum(low[:-width], low[width:], out=low[:-width])
            levels.append(low)
            width *= 2
        self.levels = np.stack(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each range a to b, both in it; a <= b."""
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        return np.minimum(self.levels[k, a], self.levels[k, b - (1 << k) + 1])


class Scan:
    """What scanned items induce, with common values."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, carry: bool):
        self.queues, self.carry = queues, carry
        # of each place whether the suffix before it is wanted, and its symbol
        self.hits, self.symbols = np.append(False, wanted[:-1]), np.append(text[:1], text[:-1])
        self.since = np.full(int(text.max(initial=0)) + 1, 255, np.uint8)
        self.fresh = np.ones(len(self.since), bool)

    def feed(self, place: np.ndarray, common: np.ndarray) -> None:
        """Items in their order, common being with the one scanned before."""
        hit = np.flatnonzero(self.hits[place])
        if not len(hit):
            np.minimum(self.since, common.min(), out=self.since)
            return
        symbols = self.symbols[place[hit]]
        order = np.argsort(symbols, kind="stable")
        hit, symbols = hit[order], symbols[order]
        first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        places = place[hit] - 1
        if not self.carry:
            nothing = np.zeros(len(hit), np.uint8)
            for s, a, b in zip(symbols[first].tolist(), first.tolist(), [*first[1:].tolist(), len(hit)], strict=True):
                self.queues.push(s, places[a:b], nothing[a:b])
            return
        least = Least(common)
        begin = np.append(0, hit[:-1] + 1)
        begin[first] = 0
        shared = least(np.minimum(begin, hit), hit)
        kinds = symbols[first]
        shared[first] = np.minimum(shared[first], self.since[kinds])
        value = np.minimum(shared.astype(np.int16) + 1, DEPTH).astype(np.uint8)
        value[first[self.fresh[kinds]]] = 0
        last = np.append(first[1:], len(hit)) - 1
        np.minimum(self.since, common.min(), out=self.since)
        tail = hit[last] + 1
        end = len(common) - 1
        self.since[kinds] = np.where(tail <= end, least(np.minimum(tail, end), np.full(len(tail), end)), 255)
        self.fresh[kinds] = False
        for s, a, b in zip(kinds.tolist(), first.tolist(), (last + 1).tolist(), strict=True):
            self.queues.push(s, places[a:b], value[a:b])


def common_of(text: np.ndarray, a: int, b: int) -> int:
    x, y = text[a : a + DEPTH], text[b : b + DEPTH]
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    return int(other[0]) if len(other) else n


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type; the last is."""
    n = len(text)
    changes = np.flatnonzero(text[1:] != text[:-1])
    rising = np.append(text[changes] < text[changes + 1], True)
    return np.repeat(rising, np.diff(np.append(np.append(-1, changes), n - 1)))


def induced(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, common: np.ndarray, held: int = HELD, carry: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in descending order, each with what it has in common with the one before it (without carry: with no such values). seeds: LMS places, ascending; common: with the seed before."""
    top = int(text.max())
    groups = np.searchsorted(text[seeds], np.arange(top + 2).astype(text.dtype))
    queues = Queues(held)
    scan = Scan(text, ~small, queues, carry)
    large: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for c in range(top + 1):
        last = None
        while (part := queues.pop(c)) is not None:
            place, shared = part
            if last is not None:  # a later generation's first item follows one of the generation before
                shared = shared.copy()
                shared[0] = common_of(text, last, int(place[0]))
            large.setdefault(c, []).append((place, shared))
            scan.feed(place, shared)
            last = int(place[-1])
        a, b = groups[c], groups[c + 1]
        if a < b:
            shared = common[a:b].copy()
            shared[0] = 0 if last is None else common_of(text, last, int(seeds[a]))
            scan.feed(seeds[a:b], shared)
    queues = Queues(held)
    scan = Scan(text, small, queues, carry)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    tail = np.array([len(text) - 1])
    for c in range(top, -1, -1):
        last = None
        parts = []
        if text[-1] == c:  # nothing induces the text's end, the smallest of its symbol: it comes last
            end = (tail, np.zeros(1, np.uint8))
        while (part := queues.pop(c)) is not None:
            place, shared = part
            shared = shared.copy()
            shared[0] = 0 if last is None else common_of(text, last, int(place[0]))
            parts.append((place, shared))
            scan.feed(place, shared)
            last = int(place[-1])
        up = large.get(c)
        if up:
            place = np.concatenate([p for p, _ in up])[::-1]
            ascending = np.concatenate([s for _, s in up])
            shared = np.append(np.uint8(0), ascending[1:][::-1])
            shared[0] = 0 if last is None else common_of(text, last, int(place[0]))
            parts.append((place, shared))
            scan.feed(place, shared)
        if text[-1] == c:
            parts.append(end)
            scan.feed(*end)
            while (part := queues.pop(c)) is not None:
                parts.append(part)
                scan.feed(*part)
        out += parts
    return np.concatenate([p for p, _ in out]), np.concatenate([s for _, s in out])


def suffixes(text: np.ndarray, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """text: integers below 2^16, its end a symbol less than all others. All suffixes in descending order of DEPTH symbols or more, each with what it has in common with the one before it, up to DEPTH."""
    text = text.astype(np.uint8 if text.max(initial=0) < 256 else np.uint16)  # sorted by radix, and small in caches
    n = len(text)
    small = types(text)
    lms = np.flatnonzero(small & np.append(False, ~small[:-1]))
    if not len(lms):
        return induced(text, small, np.zeros(0, np.int64), np.zeros(0, np.uint8), held)
    # first induction: from LMS places that only their symbols sort
    rough = lms[np.argsort(text[lms], kind="stable")]
    place, _ = induced(text, small, rough, np.zeros(len(rough), np.uint8), held, carry=False)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = place[is_lms[place]][::-1]
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    order = index[by_substring]
    # the string of names, by doubling: a name is the place of the first of its equals; only what has equals is sorted on
    places = np.arange(len(lms))
    new = changed(text, lms, order) == 1
    names = np.empty(len(lms), np.int64)
    names[order] = np.maximum.accumulate(np.where(new, places, 0))
    new[0] = True
    left = np.flatnonzero(~(new & np.append(new[1:], True)))
    covered = 2
    while len(left) and covered < DEPTH:
        step = covered // 2
        items = order[left]
        follow = np.where(items + step < len(lms), names[np.minimum(items + step, len(lms) - 1)] + 1, 0)
        both = names[items] * (len(lms) + 2) + follow
        by = np.argsort(both)
        items, both = items[by], both[by]
        order[left] = items
        new = np.append(True, both[1:] != both[:-1])
        names[items] = np.maximum.accumulate(np.where(new, left, 0))
        left = left[~(new & np.append(new[1:], True))]
        covered *= 2
    seeds = lms[order]
    return induced(text, small, seeds, neighbours_common(text, seeds), held)


def words(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The eight bytes from each place on, with zeros past the end, and how many symbols these are."""
    padded = np.append(text, np.zeros(DEPTH + 8, text.dtype))
    many = 8 // text.itemsize
    return np.ndarray((len(padded) - many + 1,), "<u8", padded.astype(text.dtype.newbyteorder("<")), strides=(text.itemsize,)), many


def changed(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """1 where an LMS substring differs from the one before it in order, else 0 (the first: 0)."""
    stop = np.append(lms[1:], len(text) - 1)
    size = (stop - lms + 1)[order]
    begin = lms[order]
    word, many = words(text)
    # of a word the first symbols, as many as are left
    masks = np.array([(1 << 8 * text.itemsize * k) - 1 for k in range(many + 1)], np.uint64)
    out = np.zeros(len(order), np.int64)
    out[1:] = size[1:] != size[:-1]
    left = np.flatnonzero(out[1:] == 0) + 1
    i = 0
    while len(left):
        differ = ((word[begin[left] + i] ^ word[begin[left - 1] + i]) & masks[np.minimum(size[left] - i, many)]) != 0
        out[left[differ]] = 1
        i += many
        left = left[~differ]
        left = left[size[left] > i]
    return out


def neighbours_common(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """What each suffix of seeds has in common with the one before, up to DEPTH; eight bytes are compared at once."""
    word, many = words(text)
    out = np.zeros(len(seeds), np.int64)
    left = np.arange(1, len(seeds))
    for i in range(0, DEPTH, many):
        differ = word[seeds[left] + i] ^ word[seeds[left - 1] + i]
        other = np.flatnonzero(differ)
        lowest = differ[other] & (~differ[other] + np.uint64(1))
        out[left[other]] = i + (np.frexp(lowest.astype(np.float64))[1] - 1) // (8 * text.itemsize)
        left = left[differ == 0]
    out[left] = DEPTH
    # past the end zeros stand for what isn't there
    out[1:] = np.minimum(out[1:], len(text) - np.maximum(seeds[1:], seeds[:-1]))
    return np.minimum(out, DEPTH).astype(np.uint8)
