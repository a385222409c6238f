"""Photometric interpretations to red, green and blue, as Column expressions.

Each function returns three Columns of 0 to 255. Bands are Columns, most is the number of
values of a sample (2^bits), as a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.errors import RasterError
from tessel.functions.dictionary import Photometric
from tessel.functions.values import to_uint8, to_uint8_clamp

# The white point (D65) and the matrix from XYZ to linear sRGB.
WHITE = (0.95047, 1.0, 1.08883)
XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.204, 1.057))


def from_white_is_zero(value: Column, most: float) -> tuple[Column, ...]:
    """256 less the share of 256, so that 0 wraps round to 0."""
    grey = to_uint8(F.lit(256.0) - value.cast("double") / float(most) * 256.0)
    return grey, grey, grey


def from_black_is_zero(value: Column, most: float) -> tuple[Column, ...]:
    grey = to_uint8(value.cast("double") / float(most) * 256.0)
    return grey, grey, grey


def from_palette(value: Column, colour_map: Column) -> tuple[Column, ...]:
    """colour_map: all reds, then greens, then blues, of 16 bits. No entry for a value (or a fractional one) gives 0."""
    third = (F.size(colour_map) / 3).cast("int")
    index = F.when((value.cast("double") == F.floor(value.cast("double"))) & (value.cast("double") >= 0) & (value.cast("double") < F.lit(float(1 << 30))), value.cast("int"))
    return tuple(to_uint8(F.coalesce(F.get(colour_map, index + third * i).cast("double"), F.lit(0.0)) / 65536.0 * 256.0) for i in range(3))


def from_cmyk(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    black = (F.lit(255.0) - k.cast("double")) / 256.0
    return tuple(to_uint8(F.lit(255.0) * ((F.lit(255.0) - x.cast("double")) / 256.0) * black) for x in (c, m, y))


def from_y_cb_cr(y: Column, cb: Column, cr: Column) -> tuple[Column, ...]:
    y, cb, cr = (x.cast("double") for x in (y, cb, cr))
    red = y + F.lit(1.402) * (cr - 128.0)
    green = y - F.lit(0.34414) * (cb - 128.0) - F.lit(0.71414) * (cr - 128.0)
    blue = y + F.lit(1.772) * (cb - 128.0)
    return tuple(to_uint8_clamp(x) for x in (red, green, blue))


def from_cie_lab(lightness: Column, a: Column, b: Column) -> tuple[Column, ...]:
    """lightness as it is; a and b as bytes read as signed."""
    signed = lambda x: named(to_uint8(x), lambda v: F.when(v >= 128, v - 256).otherwise(v).cast("double"))
    cube = lambda v: F.when(v * v * v > 0.008856, v * v * v).otherwise((v - 16.0 / 116.0) / 7.787)

    def linear(f: Column) -> list[Column]:
        xyz = [f[n] * w for n, w in zip("xyz", WHITE, strict=True)]
        return [xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2] for row in XYZ_TO_RGB]

    def gamma(line: Column) -> Column:
        raised = F.when(line > 0.0031308, F.pow(F.abs(line), F.lit(1.0 / 2.4)) * 1.055 - 0.055).otherwise(line * 12.92)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raised)) * 255.0

    y = (lightness.cast("double") + 16.0) / 116.0
    f = F.struct(*(named(v, cube).alias(n) for v, n in zip((signed(a) / 500.0 + y, y, y - signed(b) / 200.0), "xyz", strict=True)))
    rgb = named(f, lambda f: F.array(*(named(named(v, gamma), to_uint8) for v in linear(f))))
    return tuple(rgb[i] for i in range(3))


def named(value: Column, function) -> Column:
    """function of value, which is computed once however often function uses it."""
    return F.transform(F.array(value), function)[0]


def to_rgb(photometric: int, bands: list[Column], most: float, colour_map: Column | None = None, alpha: bool = False) -> tuple[Column, ...]:
    """The bands of a pixel as red, green, blue (and the further bands of an RGB image, if alpha)."""
    match photometric:
        case Photometric.WHITE_IS_ZERO:
            return from_white_is_zero(bands[0], most)
        case Photometric.BLACK_IS_ZERO:
            return from_black_is_zero(bands[0], most)
        case Photometric.RGB:
            return tuple(bands if alpha else bands[:3])
        case Photometric.PALETTE if colour_map is not None:
            return from_palette(bands[0], colour_map)
        case Photometric.CMYK:
            return from_cmyk(*bands[:4])
        case Photometric.Y_CB_CR:
            return from_y_cb_cr(*bands[:3])
        case Photometric.CIE_LAB:
            return from_cie_lab(*bands[:3])
    raise RasterError("Invalid or unsupported photometric interpretation.")
