"""A byte-level convolutional network in numpy.

One layer of filters runs over the bytes of a document at stride 1. Over one-hot bytes a
filter of width w is w tables of 256 weights, so a layer is an array
(WIDTH, 256, FILTERS), and its value at a position is a sum of WIDTH looked-up rows.
Chunks of CHUNK positions, each overlapping the next by half, are max-pooled; the mean
and the maximum of the pooled values over all chunks of a document go through one
logistic unit. Every byte of a document, however long, is in some chunk. The layer's values
are worked through in slices; beside them a text's bytes and pairs of bytes are held, and
16 maxima for each half chunk, some 6 bytes a byte of text.
"""

from __future__ import annotations

import numpy as np

WIDTH, FILTERS, CHUNK = 8, 16, 512
HALF = CHUNK // 2
#: Positions worked on at a time.
SLICE = 1 << 16


class Convnet:
    def __init__(self, layer: np.ndarray, bias: np.ndarray, out: np.ndarray, base: float):
        self.layer, self.bias, self.out, self.base = layer, bias, out, base
        self._pairs: np.ndarray | None = None

    def __getstate__(self):
        return self.layer, self.bias, self.out, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def pairs(self) -> np.ndarray:
        """The layer by pairs of bytes: (WIDTH / 2, 65536, FILTERS)."""
        if self._pairs is None:
            self._pairs = (self.layer[0::2][:, :, None, :] + self.layer[1::2][:, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)
        return self._pairs

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 for each text."""
        if not texts:
            return np.zeros(0)
        data, halves = packed(texts)
        tops = self.tops(data, halves)
        return 1 / (1 + np.exp(-self.logits(tops, halves)[0]))

    def tops(self, data: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """For each half chunk and filter the largest value."""
        n = len(data) - WIDTH
        last = is_last(halves)
        two = data[:-1].astype(np.int32) * 256 + data[1:]
        tops = np.empty((n // HALF, FILTERS), np.float32)
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            value = self.pairs[0][two[a:b]]
            for j in range(1, WIDTH // 2):
                value += self.pairs[j][two[a + 2 * j : b + 2 * j]]
            value = value.reshape(-1, HALF, FILTERS)
            part = slice(a // HALF, b // HALF)
            value[last[part], 1 - WIDTH :] = -np.inf
            tops[part] = value.max(1)
        return tops

    def logits(self, tops: np.ndarray, halves: np.ndarray):
        """Of each document, from its half chunks; and what the gradient needs."""
        ends = np.cumsum(halves)
        begins = ends - halves
        after = np.arange(len(tops)) + 1
        after[ends - 1] -= 1  # a document's last half chunk has no other after it
        late = tops[after] > tops
        pooled = np.where(late, tops[after], tops) + self.bias
        active = np.maximum(pooled, 0)
        mean = np.add.reduceat(active, begins) / halves[:, None]
        most = np.maximum.reduceat(active, begins)
        features = np.concatenate([mean, most], 1)
        # a row's sum in double precision doesn't depend on the rows beside it
        return (features.astype(np.float64) * self.out).sum(1) + self.base, (features, active, late, after, begins)


def is_last(halves: np.ndarray) -> np.ndarray:
    """Whether a half chunk is a document's last; its last WIDTH - 1 positions, past the filling of zeros, see the next document and don't count."""
    out = np.zeros(int(halves.sum()), bool)
    out[np.cumsum(halves) - 1] = True
    return out


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each filled up with zeros to whole half chunks, and how many these are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    halves = np.maximum(1, -(-(sizes + WIDTH) // HALF))
    begins = np.cumsum(halves) - halves
    data = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    for t, a in zip(texts, begins * HALF, strict=True):
        data[a : a + len(t)] = np.frombuffer(t, np.uint8)
    return data, halves


def fitted(texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Convnet:
    """A network fitted to texts by Adam on the logistic loss; with one kind of label at most it says their share."""
    draw = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    net = Convnet(draw.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        return net
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (net.layer, net.bias, net.out, np.zeros(1, np.float32))]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            grads = gradient(net, [texts[i] for i in rows], y[rows])
            step += 1
            for i, g in enumerate(grads):
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                if i < 3:
                    (net.layer, net.bias, net.out)[i][...] -= change
                else:
                    net.base -= float(change[0])
            net._pairs = None
    return net


def gradient(net: Convnet, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """Of the mean loss, by layer, bias, out and base."""
    data, halves = packed(texts)
    tops, at = narrow(net, data, halves)
    logit, (features, active, late, after, begins) = net.logits(tops, halves)
    wrong = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
    document = np.repeat(np.arange(len(texts)), halves)
    by_mean = (wrong / halves)[document][:, None] * net.out[:FILTERS]
    most = features[:, FILTERS:]
    first = (active == most[document]) & (active > 0)
    first &= np.add.reduceat(first, begins)[document] > 0
    ties = np.maximum(1, np.add.reduceat(first.astype(np.float32), begins))[document]
    flow = (by_mean + wrong[document][:, None] * net.out[FILTERS:] * first / ties) * (active > 0)
    half = np.where(late, after[:, None], np.arange(len(tops))[:, None])
    position = half * HALF + at[half, np.arange(FILTERS)[None, :]]
    layer = np.zeros_like(net.layer)
    column = np.broadcast_to(np.arange(FILTERS), position.shape)
    for j in range(WIDTH):
        cell = data[position + j].astype(np.int64) * FILTERS + column
        layer[j] = np.bincount(cell.ravel(), flow.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [layer, flow.sum(0), features.T.astype(np.float32) @ wrong, np.array([wrong.sum()], np.float32)]


def narrow(net: Convnet, data: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tops() with positions, from single bytes: while fitting, tables of pairs would be made anew at each step."""
    n = len(data) - WIDTH
    last = is_last(halves)
    tops, at = np.empty((n // HALF, FILTERS), np.float32), np.empty((n // HALF, FILTERS), np.int32)
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        value = net.layer[0][data[a:b]]
        for j in range(1, WIDTH):
            value += net.layer[j][data[a + j : b + j]]
        value = value.reshape(-1, HALF, FILTERS)
        part = slice(a // HALF, b // HALF)
        value[last[part], 1 - WIDTH :] = -np.inf
        at[part], tops[part] = value.argmax(1), value.max(1)
    return tops, at
