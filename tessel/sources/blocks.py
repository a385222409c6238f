"""Blocks of an image: which there are, and how their bytes become arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tessel.errors import RasterError
from tessel.plans.pixels import Window
from tessel.sources.codecs import Decoder, get_decoder, unpacked, unpredicted
from tessel.sources.jpeg import spliced
from tessel.sources.tiff import Directory, Fetch


@dataclass
class Block:
    """A decoded tile or strip: an array (height, width) for each sample it holds."""

    bx: int
    by: int
    x0: int
    y0: int
    samples: list[int]
    arrays: list[np.ndarray]


def places(image: Directory, window: Window | None = None, samples: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """bx, by and sample (-1: all of them) of the blocks that a window meets; of planar images those of the wanted samples only."""
    window = window or Window.full(image.width, image.height)
    if not image.block_width or not image.block_height:
        return
    xs, ys = window.blocks(image.block_width, image.block_height, image.width, image.height)
    wanted = sorted(set(samples or range(image.samples))) if image.planar == 2 else [-1]
    for sample in wanted:
        for by in ys:
            for bx in xs:
                yield bx, by, sample


def location(image: Directory, bx: int, by: int, sample: int) -> tuple[int, int]:
    """Offset and byte count."""
    i = by * image.across + bx + (sample * image.across * image.down if sample >= 0 else 0)
    offsets, counts = image.offsets, image.byte_counts
    if i >= len(offsets) or i >= len(counts):
        raise RasterError(f"Block {i} is not in the file's tables")
    return offsets[i], counts[i]


def decoded(image: Directory, fetch: Fetch, bx: int, by: int, sample: int, registry: dict[int, Decoder] | None = None) -> Block:
    """Fetches, decompresses, undoes the predictor and unpacks; a block without bytes is full of nodata (or 0)."""
    if not (0 <= bx < image.across and 0 <= by < image.down):
        raise RasterError(f"No block at {bx}, {by}")
    held = list(range(image.samples)) if sample < 0 else [sample]
    bits, formats = [image.bits[s] for s in held], [image.formats[s] for s in held]
    if any(f not in (1, 2, 3) for f in formats):
        raise RasterError("Unsupported data format/bitsPerSample")
    w, h = image.block_width, image.height_of(by)
    offset, count = location(image, bx, by, sample)
    where = (bx, by, bx * image.block_width, by * image.block_height, held)
    if count == 0:
        empty = unpacked(b"", w, h, bits, formats, image.order)
        nodata = image.nodata
        if nodata is not None:
            empty = [np.full(a.shape, nodata if a.dtype.kind == "f" else int(nodata) if np.isfinite(nodata) else 0).astype(a.dtype) for a in empty]
        return Block(*where, empty)
    data = fetch(offset, count)
    if image.compression == 7:
        data = spliced(data, bytes(image.numbers("JPEGTables") or b""))
    data = get_decoder(image.compression, registry)(data)
    data, order = unpredicted(data, image.predictor, w, h, bits, len(held), image.order)
    return Block(*where, unpacked(data, w, h, bits, formats, order))


def widest(image: Directory) -> str:
    """The type of interleaved results: the highest format and the most bits over all samples."""
    from tessel.sources.codecs import dtype_of

    rank = {1: 0, 2: 1, 3: 2}
    if any(f not in rank for f in image.formats):
        raise RasterError("Unsupported sample format for interleaved data. Must be 1, 2, or 3.")
    return dtype_of(max(image.formats, key=rank.__getitem__), max(image.bits))


def stitched(image: Directory, blocks: Iterator[Block], window: Window, samples: list[int], fill: float | list[float] | None = None) -> list[np.ndarray]:
    """Arrays (height, width), one for each wanted sample, of what blocks have of the window; elsewhere the fill value."""
    from tessel.sources.codecs import dtype_of

    values = fill if isinstance(fill, list) else [fill] * len(samples)
    values = list(values) + [0] * (len(samples) - len(values))
    out = []
    for s, v in zip(samples, values, strict=False):
        out.append(np.full((window.height, window.width), 0 if v is None or v != v else v, dtype_of(image.formats[s], image.bits[s])))
    for b in blocks:
        for s, a in zip(b.samples, b.arrays, strict=True):
            x0, x1 = max(window.x0, b.x0), min(window.x1, b.x0 + a.shape[1], image.width)
            y0, y1 = max(window.y0, b.y0), min(window.y1, b.y0 + a.shape[0], image.height)
            if x0 < x1 and y0 < y1:
                for i, wanted in enumerate(samples):
                    if wanted == s:
                        out[i][y0 - window.y0 : y1 - window.y0, x0 - window.x0 : x1 - window.x0] = a[y0 - b.y0 : y1 - b.y0, x0 - b.x0 : x1 - b.x0]
    return out
