"""Resampling and colour on arrays (height, width): the tile plane's counterparts of the pixel plane's expressions."""

from __future__ import annotations

import numpy as np

from tessel.errors import RasterError
from tessel.functions.colour import WHITE, XYZ_TO_RGB


def stored(value: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Doubles as elements of dtype: not finite 0, toward zero, modulo the type's size."""
    if dtype.kind == "f":
        return value.astype(dtype)
    whole = np.trunc(np.where(np.isfinite(value), value, 0))
    size = 2.0 ** (8 * dtype.itemsize)
    low = np.mod(whole, size)
    return np.where(low < size, low, 0).astype(np.uint64).astype(f"u{dtype.itemsize}").view(dtype)


def of_new_size(a: np.ndarray, width: int, height: int, samples: int = 1) -> np.ndarray:
    """Zeros of a's type for an image of that size."""
    return np.zeros(width * height * samples, a.dtype)


def nearest(a: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = a.shape
    ys = np.minimum(np.floor(h / height * np.arange(height) + 0.5).astype(int), h - 1)
    xs = np.minimum(np.floor(w / width * np.arange(width) + 0.5).astype(int), w - 1)
    return a[ys[:, None], xs[None, :]]


def bilinear(a: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = a.shape
    ry, rx = h / height * np.arange(height), w / width * np.arange(width)
    yl, xl = np.floor(ry).astype(int), np.floor(rx).astype(int)
    yh, xh = np.minimum(np.ceil(ry).astype(int), h - 1), np.minimum(np.ceil(rx).astype(int), w - 1)
    ty, tx = (ry - yl)[:, None], (rx - xl)[None, :]
    v = a.astype(np.float64)
    low = (1 - tx) * v[yl][:, xl] + tx * v[yl][:, xh]
    high = (1 - tx) * v[yh][:, xl] + tx * v[yh][:, xh]
    return stored((1 - ty) * low + ty * high, a.dtype)


def resampled(arrays: list[np.ndarray], width: int | None, height: int | None, method: str = "nearest") -> list[np.ndarray]:
    functions = {"nearest": nearest, "bilinear": bilinear, "linear": bilinear}
    if method.lower() not in functions:
        raise RasterError(f"Unsupported resampling method: '{method}'")
    out = []
    for a in arrays:
        size = (width or a.shape[1], height or a.shape[0])
        if not a.size and (size[0] and size[1]):
            raise RasterError("An empty raster can't be resampled")
        out.append(a if size == (a.shape[1], a.shape[0]) else functions[method.lower()](a, *size))
    return out


U8 = np.dtype(np.uint8)


def clamped(value: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.nan_to_num(value, nan=0.0), 0, 255)).astype(np.uint8)


def to_rgb(photometric: int | None, bands: list[np.ndarray], most: float, colour_map: list[int] | None = None, alpha: bool = False) -> list[np.ndarray]:
    v = [b.astype(np.float64) for b in bands]
    match photometric:
        case 0:
            return [stored(256 - v[0] / most * 256, U8)] * 3
        case 1:
            return [stored(v[0] / most * 256, U8)] * 3
        case 2:
            return bands if alpha else bands[:3]
        case 3 if colour_map:
            table = np.array(colour_map, np.float64)
            third = len(table) // 3
            good = (v[0] == np.floor(v[0])) & (v[0] >= 0) & (v[0] < len(table))
            index = np.where(good, v[0], 0).astype(int)
            entry = lambda i: np.where(good & (index + third * i < len(table)), table[np.minimum(index + third * i, len(table) - 1)], 0)
            return [stored(entry(i) / 65536 * 256, U8) for i in range(3)]
        case 5:
            return [stored(255 * ((255 - x) / 256) * ((255 - v[3]) / 256), U8) for x in v[:3]]
        case 6:
            y, cb, cr = v[0], v[1] - 128, v[2] - 128
            return [clamped(y + 1.402 * cr), clamped(y - 0.34414 * cb - 0.71414 * cr), clamped(y + 1.772 * cb)]
        case 8:
            signed = lambda x: stored(x, U8).view(np.int8).astype(np.float64)
            y = (v[0] + 16) / 116
            f = [signed(v[1]) / 500 + y, y, y - signed(v[2]) / 200]
            xyz = [w * np.where(t**3 > 0.008856, t**3, (t - 16 / 116) / 7.787) for t, w in zip(f, WHITE, strict=True)]
            line = [sum(c * t for c, t in zip(row, xyz, strict=True)) for row in XYZ_TO_RGB]
            return [stored(np.clip(np.where(t > 0.0031308, 1.055 * np.abs(t) ** (1 / 2.4) - 0.055, 12.92 * t), 0, 1) * 255, U8) for t in line]
    raise RasterError("Invalid or unsupported photometric interpretation.")
