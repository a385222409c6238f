"""Raster operators over pixels: rows of y, x, sample, value, and key columns that tell images apart.

All are plans of built-in expressions. Where an operator looks pixels up at computed
places (fill, resampling) that is an equi-join on the place, so it is dealt by place and
not by image, and one large image is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as Over

from tessel.errors import RasterError
from tessel.functions.values import lerp

PLACE = ["y", "x"]


@dataclass(frozen=True)
class Window:
    """A half-open box of pixels; it may reach beyond the image."""

    x0: int
    y0: int
    x1: int
    y1: int

    def __post_init__(self) -> None:
        if self.x0 > self.x1 or self.y0 > self.y1:
            raise RasterError("Invalid subsets")

    @property
    def width(self) -> int:
        return self.x1 - self.x0

    @property
    def height(self) -> int:
        return self.y1 - self.y0

    @classmethod
    def full(cls, width: int, height: int) -> Window:
        return cls(0, 0, width, height)

    def blocks(self, block_w: int, block_h: int, width: int, height: int) -> tuple[range, range]:
        """The columns and rows of blocks that the window meets."""
        x0, x1 = max(0, self.x0), min(self.x1, width)
        y0, y1 = max(0, self.y0), min(self.y1, height)
        if x0 >= x1 or y0 >= y1:
            return range(0), range(0)
        return range(x0 // block_w, -(-x1 // block_w)), range(y0 // block_h, -(-y1 // block_h))


def within(pixels: DataFrame, window: Window) -> DataFrame:
    """The pixels of a window, counted from its corner: plain range predicates, pushed down to the scan where it can."""
    x, y = F.col("x"), F.col("y")
    inside = pixels.where((x >= window.x0) & (x < window.x1) & (y >= window.y0) & (y < window.y1))
    return inside.withColumn("x", x - window.x0).withColumn("y", y - window.y0)


def cropped(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Without the padding of edge tiles."""
    return pixels.where((F.col("x") < width) & (F.col("y") < height))


def chosen(pixels: DataFrame, samples: list[int], count: int) -> DataFrame:
    """The given samples in the given order, repeats included; none given means all."""
    if not samples:
        return pixels
    for s in samples:
        if not 0 <= s < count:
            raise RasterError(f"Invalid sample index '{s}'.")
    places = F.array(*(F.array(*(F.lit(i) for i, t in enumerate(samples) if t == s)).cast("array<int>") for s in range(count)))
    return pixels.withColumn("sample", F.explode(F.get(places, F.col("sample"))))


def grid(spark: SparkSession, width: int, height: int, samples: int = 1) -> DataFrame:
    """Every place of a raster: y, x, sample, from one range of numbers."""
    i = F.col("id")
    return spark.range(width * height * samples).select(F.floor(i / (width * samples)).cast("long").alias("y"), (F.floor(i / samples) % width).cast("long").alias("x"), (i % samples).cast("int").alias("sample"))


def filled(pixels: DataFrame, window: Window, samples: int, fill: float | list[float] | None = None) -> DataFrame:
    """Every place of a window: pixels where there are any, else the fill value (0 if none). A list has a value for each sample; what it lacks is 0."""
    values = fill if isinstance(fill, list) else [fill or 0] * samples
    values = [0 if v is None or v != v else v for v in values] + [0] * max(0, samples - len(values))
    other = F.get(F.array(*(F.lit(float(v)) for v in values)), F.col("sample"))
    places = grid(pixels.sparkSession, window.width, window.height, samples)
    return places.join(within(pixels, window), [*PLACE, "sample"], "left").select(*PLACE, "sample", F.coalesce(F.col("value").cast("double"), other).alias("value"))


def nearest(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Nearest neighbours; samples stay together. Source rows and columns are two small lists, so each pixel is met once for every place that takes it."""
    if (width, height) == (new_width, new_height):
        return pixels

    def takers(coordinate: str, size: int, new: int) -> Column:
        ratio = float(size) / float(new)
        at = lambda o: F.least(F.floor(F.lit(ratio) * o + 0.5), F.lit(size - 1))
        low = F.floor((F.col(coordinate).cast("double") - 0.5) / ratio) - 1
        high = F.when(F.col(coordinate) >= size - 1, F.lit(new - 1)).otherwise(F.ceil((F.col(coordinate).cast("double") + 0.5) / ratio) + 1)
        span = F.sequence(F.greatest(low, F.lit(0)).cast("long"), F.greatest(F.least(high, F.lit(new - 1)), F.greatest(low, F.lit(0))).cast("long"))
        return F.filter(span, lambda o: (at(o) == F.col(coordinate)) & (o < new))

    return pixels.withColumn("y", F.explode(takers("y", height, new_height))).withColumn("x", F.explode(takers("x", width, new_width)))


def bilinear(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Linear along x, then along y. Each place asks for its four corners, one join finds them, and one aggregate, on the place, puts them together."""
    if (width, height) == (new_width, new_height):
        return pixels
    spark = pixels.sparkSession
    rx, ry = float(width) / float(new_width), float(height) / float(new_height)
    raw_x, raw_y = F.col("ox") * F.lit(rx), F.col("oy") * F.lit(ry)
    low = lambda raw: F.floor(raw)
    high = lambda raw, size: F.least(F.ceil(raw), F.lit(size - 1))
    corners = F.array(*(F.struct(F.lit(i).alias("corner"), y.cast("long").alias("y"), x.cast("long").alias("x")) for i, (y, x) in enumerate(((low(raw_y), low(raw_x)), (low(raw_y), high(raw_x, width)), (high(raw_y, height), low(raw_x)), (high(raw_y, height), high(raw_x, width))))))
    asked = grid(spark, new_width, new_height).select(F.col("y").alias("oy"), F.col("x").alias("ox")).select("oy", "ox", F.explode(corners).alias("c")).select("oy", "ox", "c.*")
    joined = asked.join(pixels.select(*PLACE, "sample", F.col("value").cast("double").alias("value")), PLACE)
    four = joined.groupBy("oy", "ox", "sample").agg(*(F.max(F.when(F.col("corner") == i, F.col("value"))).alias(f"v{i}") for i in range(4)))
    tx, ty = raw_x - F.floor(raw_x), raw_y - F.floor(raw_y)
    value = lerp(lerp(F.col("v0"), F.col("v1"), tx), lerp(F.col("v2"), F.col("v3"), tx), ty)
    return four.select(F.col("oy").alias("y"), F.col("ox").alias("x"), "sample", value.alias("value"))


def resampled(pixels: DataFrame, width: int, height: int, new_width: int | None, new_height: int | None, method: str = "nearest") -> DataFrame:
    """No or zero new size keeps an axis."""
    new_width, new_height = new_width or width, new_height or height
    match method.lower():
        case "nearest":
            return nearest(pixels, width, height, new_width, new_height)
        case "bilinear" | "linear":
            return bilinear(pixels, width, height, new_width, new_height)
    raise RasterError(f"Unsupported resampling method: '{method}'")


def interleaved(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row of each image with its values in the order of y, x, sample."""
    keys = keys or []
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "sample", "value")))
    return pixels.groupBy(*keys).agg(F.transform(ordered, lambda p: p["value"]).alias("values"))


def bands(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row of each image and sample with its values in the order of y, x."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    return pixels.groupBy(*(keys or []), "sample").agg(F.transform(ordered, lambda p: p["value"]).alias("values"))


def wide(pixels: DataFrame, count: int, keys: list[str] | None = None) -> DataFrame:
    """One row of each pixel with a column b0, b1, ... for each sample."""
    return pixels.groupBy(*(keys or []), *PLACE).agg(*(F.max(F.when(F.col("sample") == i, F.col("value"))).alias(f"b{i}") for i in range(count)))


def horizontal(pixels: DataFrame, bits: int, keys: list[str] | None = None, block_width: int | None = None) -> DataFrame:
    """Undoes predictor 2: running sums of each row and sample of a block, modulo 2^bits. A row is a window of its own, so rows are dealt out."""
    part = [*(keys or []), "y", "sample", *([F.floor(F.col("x") / block_width)] if block_width else [])]
    run = Over.partitionBy(*part).orderBy("x").rowsBetween(Over.unboundedPreceding, 0)
    return pixels.withColumn("value", F.pmod(F.sum("value").over(run), F.lit(1 << bits)).cast("long"))


def floating(coded: DataFrame, width: int, samples: int, size: int, keys: list[str] | None = None) -> DataFrame:
    """Undoes predictor 3 on bytes: coded has y, i (place in the row), value; the result y, x, sample, byte (0 the most significant), value."""
    run = Over.partitionBy(*(keys or []), "y", F.col("i") % samples).orderBy("i").rowsBetween(Over.unboundedPreceding, 0)
    summed = coded.withColumn("value", F.pmod(F.sum("value").over(run), F.lit(256)).cast("long"))
    place = F.col("i") % (width * samples)
    return summed.select(*(keys or []), "y", F.floor(place / samples).cast("long").alias("x"), (place % samples).cast("int").alias("sample"), F.floor(F.col("i") / (width * samples)).cast("int").alias("byte"), "value")


def unpacked(rows: DataFrame, bits: int, per_row: int, signed: bool = False) -> DataFrame:
    """rows: y, data (bytes of a row, padded to whole bytes). Samples of so many bits, most significant first: y, x, value."""
    first = F.floor(F.col("x") * bits / 8).cast("int")
    count = (bits + 7) // 8 + 1
    exploded = rows.select("y", "data", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("x"))
    whole = F.lit(0).cast("long")
    for i in range(count):
        byte = F.coalesce(F.conv(F.hex(F.substring(F.col("data"), first + 1 + i, F.lit(1))), 16, 10).cast("long"), F.lit(0).cast("long"))
        whole = whole * 256 + byte
    shift = count * 8 - bits - (F.col("x") * bits % 8)
    value = F.expr("0L") + F.floor(whole / F.pow(F.lit(2.0), shift)).cast("long") % (1 << bits)
    if signed:
        value = F.when(value >= (1 << (bits - 1)), value - (1 << bits)).otherwise(value)
    return exploded.select("y", F.col("x").cast("long").alias("x"), value.alias("value"))


def emptied(blocks: DataFrame, nodata: float | None) -> Column:
    """The value of every pixel of a block without bytes, null for other blocks."""
    return F.when(F.col("byte_count") == 0, F.lit(float(nodata or 0)))


def block_table(images: DataFrame) -> DataFrame:
    """images: image_id, width, height, block_w, block_h and more. One row for each block, with its box cut to the image."""
    across, down = F.ceil(F.col("width") / F.col("block_w")), F.ceil(F.col("height") / F.col("block_h"))
    each = images.select("*", F.explode(F.sequence(F.lit(0).cast("long"), across * down - 1)).alias("block"))
    bx, by = F.col("block") % across, F.floor(F.col("block") / across)
    each = each.withColumn("bx", bx).withColumn("by", by)
    x0, y0 = F.col("bx") * F.col("block_w"), F.col("by") * F.col("block_h")
    return each.withColumn("x0", x0).withColumn("y0", y0).withColumn("w", F.least(F.col("block_w"), F.col("width") - F.col("x0"))).withColumn("h", F.least(F.col("block_h"), F.col("height") - F.col("y0"))).drop("block")


def pruned(blocks: DataFrame, window: Window) -> DataFrame:
    """The blocks that meet a window, by predicates on bx and by that reach the scan."""
    bx, by = F.col("bx") * F.col("block_w"), F.col("by") * F.col("block_h")
    return blocks.where((bx < window.x1) & (bx + F.col("block_w") > window.x0) & (by < window.y1) & (by + F.col("block_h") > window.y0))


def offsets(counts: DataFrame, keys: list[str] | None = None, begin: int = 1000) -> DataFrame:
    """counts: place, byte_count. Adds offset, where each block begins."""
    before = Over.partitionBy(*(keys or [])).orderBy("place").rowsBetween(Over.unboundedPreceding, -1)
    return counts.withColumn("offset", F.lit(begin).cast("long") + F.coalesce(F.sum("byte_count").over(before), F.lit(0).cast("long")))
