"""Where images lie on the ground, and which of a file's images fits a request.

All are expressions over a table of images with width, height, tiepoint, pixel_scale and
transform (arrays of doubles, null where the tag is absent).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.errors import RasterError
from tessel.functions.values import js_round
from tessel.plans.pixels import Window

NO_AFFINE = "The image does not have an affine transformation."


def origin() -> Column:
    """An array x, y, z: from a single tie point, else from the matrix (an error if it's too short), else null."""
    t, m = F.col("tiepoint"), F.col("transform")
    return F.when(F.size(t) == 6, F.slice(t, 4, 3)).when(F.size(m) >= 12, F.array(m[3], m[7], m[11])).when(m.isNotNull(), short("ModelTransformation", m, 12))


def short(tag: str, value: Column, least: int) -> Column:
    return F.raise_error(F.concat(F.lit(f"{tag} has "), F.size(value).cast("string"), F.lit(f" values; at least {least} are required"))).cast("array<double>")


def resolution(reference: Column | None = None) -> Column:
    """An array x, y, z of a pixel's size; reference: a struct of resolution, width, height of another image, scaled where this one has neither tag."""
    s, m = F.col("pixel_scale"), F.col("transform")
    straight = (m[1] == 0) & (m[4] == 0)
    turned = F.array(F.sqrt(m[0] * m[0] + m[4] * m[4]), -F.sqrt(m[1] * m[1] + m[5] * m[5]), m[10])
    out = F.when(F.size(s) >= 3, F.array(s[0], -s[1], s[2])).when(s.isNotNull(), short("ModelPixelScale", s, 3))
    out = out.when((F.size(m) >= 11) & straight, F.array(m[0], -m[5], m[10])).when(F.size(m) >= 11, turned).when(m.isNotNull(), short("ModelTransformation", m, 11))
    if reference is None:
        return out
    r = reference["resolution"]
    scaled = F.array(r[0] * reference["width"] / F.col("width"), r[1] * reference["height"] / F.col("height"), r[2] * reference["width"] / F.col("width"))
    return F.coalesce(out, scaled)


def bounding_box(tilegrid: bool = False) -> Column:
    """An array of least x, least y, most x, most y."""
    m, w, h = F.col("transform"), F.col("width").cast("double"), F.col("height").cast("double")
    zero = F.lit(0.0)
    xs = F.array(*(m[3] + m[0] * i + m[1] * j for i, j in ((zero, zero), (zero, h), (w, zero), (w, h))))
    ys = F.array(*(m[7] + m[4] * i + m[5] * j for i, j in ((zero, zero), (zero, h), (w, zero), (w, h))))
    turned = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    o, r = origin(), resolution()
    x2, y2 = o[0] + r[0] * w, o[1] + r[1] * h
    plain = F.array(F.least(o[0], x2), F.least(o[1], y2), F.greatest(o[0], x2), F.greatest(o[1], y2))
    return plain if tilegrid else F.when(F.size(m) >= 8, turned).otherwise(plain)


def pixel_window(box: Column) -> Column:
    """A struct x0, y0, x1, y1 of pixels for an array of ground coordinates, by origin and resolution columns of arrays."""
    o, r = F.col("origin"), F.col("resolution")
    xs = [js_round((box[i] - o[0]) / r[0]) for i in (0, 2)]
    ys = [js_round((box[i] - o[1]) / r[1]) for i in (1, 3)]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def candidates(images: DataFrame) -> DataFrame:
    """The first image and its reduced versions."""
    reduced = (F.col("subfile") == 2) | (F.col("new_subfile").bitwiseAND(1) == 1)
    return images.where((F.col("image_id") == 0) | F.coalesce(reduced, F.lit(False)))


def overview(images: DataFrame, res_x: float, res_y: float, keys: list[str] | None = None) -> DataFrame:
    """Per key the image that fits a resolution: by width the first that is finer than asked on either axis, else the widest (of equal ones the last).

    images: keys, image_id, width, height, box (the first image's bounding box). An image's
    resolution here is the box over its size. An aggregate, so it works for many files at
    once and no file's images are sorted.
    """
    box = F.col("box")
    fits = (F.lit(res_x) > (box[2] - box[0]) / F.col("width")) | (F.lit(res_y) > (box[3] - box[1]) / F.col("height"))
    row = F.struct("width", "image_id")
    best = F.coalesce(F.min(F.when(fits, row)), F.max(row))
    return images.groupBy(*(keys or [])).agg(best.alias("best")).select(*(keys or []), F.col("best.image_id").alias("image_id"))


def unset(value: float | None) -> float | None:
    return None if not value or value != value else value


def best_fit(images: list[dict], window: Window | None = None, bbox: list[float] | None = None, width: int | None = None, height: int | None = None, res_x: float | None = None, res_y: float | None = None) -> tuple[int, Window | None]:
    """The image of one file to read, and the window on it (None: all of it).

    images: in order, width, height, origin, resolution, bbox, subfile, new_subfile; a file's few images, so this is done in the driver.
    """
    if bbox is not None and window is not None:
        raise RasterError('Both "bbox" and "window" passed.')
    first = images[0]
    if first["bbox"] is None:
        raise RasterError(NO_AFFINE)
    whole = first["bbox"]
    width, height, res_x, res_y = (unset(v) for v in (width, height, res_x, res_y))
    (ox, oy), (rx, ry) = first["origin"][:2], first["resolution"][:2]
    if (width or height) and window is not None:
        bbox = [ox + window.x0 * rx, oy + window.y0 * ry, ox + window.x1 * rx, oy + window.y1 * ry]
    used = bbox if bbox is not None else whole
    if width and res_x:
        raise RasterError("Both width and resX passed")
    if height and res_y:
        raise RasterError("Both width and resY passed")
    res_x = (used[2] - used[0]) / width if width else res_x
    res_y = (used[3] - used[1]) / height if height else res_y
    index = 0
    if res_x or res_y:
        some = [i for i, im in enumerate(images) if i == 0 or im.get("subfile") == 2 or (im.get("new_subfile") or 0) & 1]
        some.sort(key=lambda i: images[i]["width"])
        fine = (i for i in some if (res_x and res_x > (whole[2] - whole[0]) / images[i]["width"]) or (res_y and res_y > (whole[3] - whole[1]) / images[i]["height"]))
        index = next(fine, some[-1])
    if bbox is None:
        return index, window
    if any(v != v or abs(v) == float("inf") for v in bbox):
        raise RasterError("Bounding box values must be finite")
    rx, ry = resolution_of(images[index], first)
    near = lambda v: math.floor(v + 0.5)
    xs, ys = sorted(near((bbox[i] - ox) / rx) for i in (0, 2)), sorted(near((bbox[i] - oy) / ry) for i in (1, 3))
    return index, Window(xs[0], ys[0], xs[1], ys[1])


def resolution_of(image: dict, first: dict) -> tuple[float, float]:
    if image["resolution"] is not None:
        return image["resolution"][0], image["resolution"][1]
    return first["resolution"][0] * first["width"] / image["width"], first["resolution"][1] * first["height"] / image["height"]
