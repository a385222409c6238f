"""XXH64 of many byte ranges of one buffer at once, in numpy; the hash as its authors publish it."""

from __future__ import annotations

import numpy as np

U = np.uint64
# Fixed values of the published hash.
P1 = U(0x9E3779B185EBCA87)
P2 = U(0xC2B2AE3D27D4EB4F)
P3 = U(0x165667B19E3779F9)
P4 = U(0x85EBCA77C2B2AE63)
P5 = U(0x27D4EB2F165667C5)


def turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def mixed(lane: np.ndarray, acc: np.ndarray | np.uint64) -> np.ndarray:
    return turned(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of data[b : b + n] for each b, n of begin, size."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    parts = np.lib.stride_tricks.sliding_window_view(data, 8)

    def lanes(at: np.ndarray) -> np.ndarray:
        return parts[at].view("<u8").ravel()

    with np.errstate(over="ignore"):
        seed = U(seed)
        size64 = size.astype(np.uint64)
        acc = np.full(len(begin), seed + P5)
        at, left = begin.astype(np.int64), size.astype(np.int64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            a, n = at[long].copy(), left[long].copy()
            v = [np.full(len(long), x) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            on = np.arange(len(long))
            while len(on):
                for i in range(4):
                    v[i][on] = mixed(lanes(a[on] + 8 * i), v[i][on])
                a[on] += 32
                n[on] -= 32
                on = on[n[on] >= 32]
            h = turned(v[0], 1) + turned(v[1], 7) + turned(v[2], 12) + turned(v[3], 18)
            for x in v:
                h = (h ^ mixed(x, U(0))) * P1 + P4
            acc[long] = h
            at[long], left[long] = a, n
        acc += size64
        on = np.flatnonzero(left >= 8)
        while len(on):
            acc[on] = turned(acc[on] ^ mixed(lanes(at[on]), U(0)), 27) * P1 + P4
            at[on] += 8
            left[on] -= 8
            on = on[left[on] >= 8]
        on = np.flatnonzero(left >= 4)
        if len(on):
            acc[on] = turned(acc[on] ^ ((lanes(at[on]) & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at[on] += 4
            left[on] -= 4
        on = np.flatnonzero(left > 0)
        while len(on):
            acc[on] = turned(acc[on] ^ (data[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
            left[on] -= 1
            on = on[left[on] > 0]
        acc = (acc ^ (acc >> U(33))) * P2
        acc = (acc ^ (acc >> U(29))) * P3
        return acc ^ (acc >> U(32))
