"""The raster engine's queries over the driver's tables, and their SQL.

Rasters are made of tables: E of embeddings (y: vec_id, x: position), E8 of the same as
bytes, G of lineitem gridded on 64 x 64 places with four integer bands. They grow with
their tables; sizes come from the tables and are never fixed here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import collections, colour, values
from tessel.plans import georeference, pixels
from tessel.plans.pixels import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIDE = 64


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- rasters -----------------------------------------------------------------------------

E_SQL = "e AS (SELECT y, pos - 1 AS x, 0 AS sample, embedding[pos]::DOUBLE AS value FROM (SELECT vec_id AS y, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))"
E8_SQL = E_SQL + ", e8 AS (SELECT y, x, sample, (trunc(abs(value) * 1000)::BIGINT % 256)::BIGINT AS value FROM e)"
G_SQL = """g AS (SELECT l_orderkey % 64 AS y, l_partkey % 64 AS x, count(*)::BIGINT % 256 AS b0, sum(trunc(l_quantity)::BIGINT)::BIGINT % 256 AS b1,
  sum(l_suppkey)::BIGINT % 256 AS b2, sum(l_linenumber)::BIGINT % 256 AS b3 FROM lineitem GROUP BY 1, 2)"""
SIZE_SQL = "size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM e)"


def e(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value"))
    return rows.select("y", F.col("x").cast("long").alias("x"), F.lit(0).alias("sample"), F.col("value").cast("double").alias("value"))


def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e(spark, sf_dir).withColumn("value", F.pmod(F.floor(F.abs("value") * 1000).cast("long"), F.lit(256)))


def g(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: F.pmod(c.cast("long"), F.lit(256)).cast("long")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % SIDE).alias("y"), (F.col("l_partkey") % SIDE).alias("x"))
        .agg(byte(F.count(F.lit(1))).alias("b0"), byte(F.sum(F.col("l_quantity").cast("long"))).alias("b1"), byte(F.sum("l_suppkey")).alias("b2"), byte(F.sum("l_linenumber")).alias("b3"))
    )


def long_form(wide: DataFrame, count: int) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("sample"), F.col(f"b{i}").alias("value")) for i in range(count)))).alias("p")
    return wide.select("y", "x", each).select("y", "x", "p.*")


def size_of(raster: DataFrame) -> tuple[int, int]:
    """Width and height."""
    h, w = raster.agg(F.max("y") + 1, F.max("x") + 1).first()
    return int(w or 0), int(h or 0)


# --- windows, samples, fill --------------------------------------------------------------

WINDOW = Window(10, 8, 50, 200)


@query(f"WITH {E_SQL} SELECT y - 8 AS y, x - 10 AS x, sample, value FROM e WHERE y >= 8 AND y < 200 AND x >= 10 AND x < 50")
def window_read(spark, sf_dir):
    return pixels.within(e(spark, sf_dir), WINDOW)


@query(f"""WITH {E_SQL}, grid AS (SELECT a.range AS y, b.range AS x FROM range(0, 12) a, range(0, 14) b)
SELECT grid.y, grid.x, 0 AS sample, coalesce(e.value, -9.0::DOUBLE) AS value FROM grid LEFT JOIN e ON e.y = grid.y - 4 AND e.x = grid.x - 5""")
def window_oob_fill(spark, sf_dir):
    return pixels.filled(e(spark, sf_dir), Window(-5, -4, 9, 8), 1, -9.0)


@query(f"""WITH {G_SQL}, l AS (SELECT y, x, 0 AS sample, b0 AS value FROM g UNION ALL SELECT y, x, 1, b1 FROM g UNION ALL SELECT y, x, 2, b2 FROM g),
grid AS (SELECT a.range AS y, b.range AS x, c.range::INTEGER AS sample FROM range(0, 70) a, range(0, 66) b, range(0, 3) c)
SELECT grid.y, grid.x, grid.sample, coalesce(l.value::DOUBLE, CASE grid.sample WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE 0 END::DOUBLE) AS value
FROM grid LEFT JOIN l ON l.y = grid.y - 2 AND l.x = grid.x - 1 AND l.sample = grid.sample""")
def window_per_band_fill(spark, sf_dir):
    return pixels.filled(long_form(g(spark, sf_dir), 3), Window(-1, -2, 65, 68), 3, [7.0, 8.0])


@query(f"WITH {G_SQL} SELECT y, x, 0 AS sample, b2 AS value FROM g UNION ALL SELECT y, x, 1, b0 FROM g UNION ALL SELECT y, x, 2, b2 FROM g")
def sample_select(spark, sf_dir):
    return pixels.chosen(long_form(g(spark, sf_dir), 4), [2, 0, 2], 4)


@query(f"""WITH {G_SQL}, l AS (SELECT y, x, unnest([b0, b1, b2, b3]) AS value, unnest(range(0, 4)) AS sample FROM g)
SELECT y, list(value ORDER BY x, sample)::VARCHAR AS "values" FROM l GROUP BY y""")
def interleave(spark, sf_dir):
    rows = pixels.interleaved(long_form(g(spark, sf_dir), 4).withColumn("row", F.col("y")), ["row"])
    return rows.select(F.col("row").alias("y"), F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")).alias("values"))


@query(f"""WITH {G_SQL}, l AS (SELECT y, x, unnest([b0, b1]) AS value, unnest(range(0, 2))::INTEGER AS sample FROM g)
SELECT y, sample, list(value ORDER BY x)::VARCHAR AS "values" FROM l GROUP BY y, sample""")
def bands(spark, sf_dir):
    rows = pixels.bands(long_form(g(spark, sf_dir), 2).withColumn("row", F.col("y")), ["row"])
    return rows.select(F.col("row").alias("y"), "sample", F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")).alias("values"))


@query(f"WITH {E_SQL} SELECT y, x, sample, value FROM e WHERE x < 50 AND y < 333")
def edge_crop(spark, sf_dir):
    return pixels.cropped(e(spark, sf_dir), 50, 333)


BLOCK_SQL = """images AS (SELECT p_partkey AS image_id, 100 + p_partkey % 900 AS width, 50 + p_size * 10 AS height, 64 AS block_w, 32 AS block_h FROM part),
blocks AS (SELECT image_id, width, height, block_w, block_h, b.bx, c.j AS "by", b.bx * 64 AS x0, c.j * 32 AS y0, least(64, width - b.bx * 64) AS w, least(32, height - c.j * 32) AS h
  FROM images, LATERAL (SELECT unnest(range(0, (width + 63) // 64)) AS bx) b, LATERAL (SELECT unnest(range(0, (height + 31) // 32)) AS j) c)"""


def part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda n: F.lit(n).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 900 + 100).alias("width"), (F.col("p_size").cast("long") * 10 + 50).alias("height"), long(64).alias("block_w"), long(32).alias("block_h"))


@query(f"WITH {BLOCK_SQL} SELECT image_id, bx, \"by\", x0, y0, w, h FROM blocks")
def block_index(spark, sf_dir):
    return pixels.block_table(part_images(spark, sf_dir)).select("image_id", "bx", "by", "x0", "y0", "w", "h")


@query(f"WITH {BLOCK_SQL} SELECT image_id, bx, \"by\" FROM blocks WHERE x0 < 300 AND x0 + 64 > 100 AND y0 < 90 AND y0 + 32 > 40")
def block_prune(spark, sf_dir):
    return pixels.pruned(pixels.block_table(part_images(spark, sf_dir)), Window(100, 40, 300, 90)).select("image_id", "bx", "by")


@query(f"WITH {E8_SQL} SELECT y, x, sample, value FROM e8 WHERE x // 16 = 2 AND y // 16 = 3")
def block_read(spark, sf_dir):
    return e8(spark, sf_dir).where((F.col("x") >= 32) & (F.col("x") < 48) & (F.col("y") >= 48) & (F.col("y") < 64))


@query(f"WITH {E8_SQL} SELECT y // 16 AS \"by\", x // 16 AS bx, list(value ORDER BY y, x)::VARCHAR AS tile FROM e8 GROUP BY 1, 2")
def tile_stitch(spark, sf_dir):
    tiled = e8(spark, sf_dir).withColumn("by", F.floor(F.col("y") / 16)).withColumn("bx", F.floor(F.col("x") / 16))
    out = pixels.interleaved(tiled, ["by", "bx"])
    return out.select("by", "bx", F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")).alias("tile"))


@query(f"WITH {E8_SQL} SELECT y, x, CASE WHEN (y // 16 + x // 16) % 5 = 0 THEN -1.0 ELSE value END::DOUBLE AS value FROM e8")
def empty_block_nodata(spark, sf_dir):
    empty = (F.floor(F.col("y") / 16) + F.floor(F.col("x") / 16)) % 5 == 0
    rows = e8(spark, sf_dir).withColumn("byte_count", F.when(empty, 0).otherwise(256))
    return rows.select("y", "x", F.coalesce(pixels.emptied(rows, -1.0), F.col("value").cast("double")).alias("value"))


# --- resampling --------------------------------------------------------------------------


def nearest_sql(source: str, w: int, h: int) -> str:
    return f"""grid AS (SELECT a.range AS y, b.range AS x FROM range(0, {h}) a, range(0, {w}) b)
SELECT grid.y, grid.x, s.sample, s.value FROM grid, size JOIN {source} s
ON s.y = least(floor(size.h::DOUBLE / {h}::DOUBLE * grid.y + 0.5)::BIGINT, size.h - 1) AND s.x = least(floor(size.w::DOUBLE / {w}::DOUBLE * grid.x + 0.5)::BIGINT, size.w - 1)"""


def bilinear_sql(source: str, w: int, h: int, value: str = "v") -> str:
    return f"""grid AS (SELECT a.range AS y, b.range AS x, h::DOUBLE / {h}::DOUBLE * a.range AS ry, w::DOUBLE / {w}::DOUBLE * b.range AS rx, size.h, size.w FROM size, range(0, {h}) a, range(0, {w}) b),
c AS (SELECT y, x, ry - floor(ry) AS ty, rx - floor(rx) AS tx, floor(ry)::BIGINT AS yl, least(ceil(ry)::BIGINT, h - 1) AS yh, floor(rx)::BIGINT AS xl, least(ceil(rx)::BIGINT, w - 1) AS xh FROM grid),
o AS (SELECT c.y, c.x, a.sample, (1.0::DOUBLE - ty) * ((1.0::DOUBLE - tx) * a.value::DOUBLE + tx * b.value::DOUBLE) + ty * ((1.0::DOUBLE - tx) * d.value::DOUBLE + tx * f.value::DOUBLE) AS v
  FROM c JOIN {source} a ON a.y = yl AND a.x = xl JOIN {source} b ON b.y = yl AND b.x = xh AND b.sample = a.sample
  JOIN {source} d ON d.y = yh AND d.x = xl AND d.sample = a.sample JOIN {source} f ON f.y = yh AND f.x = xh AND f.sample = a.sample)
SELECT y, x, sample, {value} AS value FROM o"""


@query(f"WITH {E_SQL}, {SIZE_SQL}, {nearest_sql('e', 40, 100)}")
def resample_nearest(spark, sf_dir):
    raster = e(spark, sf_dir)
    return pixels.resampled(raster, *size_of(raster), 40, 100)


@query(f"WITH {E_SQL}, {SIZE_SQL}, {bilinear_sql('e', 37, 130)}")
def resample_bilinear(spark, sf_dir):
    raster = e(spark, sf_dir)
    return pixels.resampled(raster, *size_of(raster), 37, 130, "bilinear")


@query(f"WITH {E8_SQL}, {SIZE_SQL}, {bilinear_sql('e8', 90, 90, 'trunc(v)::BIGINT % 256')}")
def resample_bilinear_uint8(spark, sf_dir):
    raster = e8(spark, sf_dir)
    out = pixels.resampled(raster, *size_of(raster), 90, 90, "Linear")
    return out.withColumn("value", values.stored(F.col("value"), "uint8"))


@query(f"WITH {E_SQL}, {SIZE_SQL}, hs AS (SELECT h, w FROM size), grid AS (SELECT a.range AS y, b.range AS x FROM hs, range(0, h) a, range(0, 20) b)"
       " SELECT grid.y, grid.x, s.sample, s.value FROM grid, hs JOIN e s ON s.y = grid.y AND s.x = least(floor(hs.w::DOUBLE / 20::DOUBLE * grid.x + 0.5)::BIGINT, hs.w - 1)")
def resize_one_axis(spark, sf_dir):
    raster = e(spark, sf_dir)
    return pixels.resampled(raster, *size_of(raster), 20, None)


@query(f"WITH {E_SQL}, w AS (SELECT y - 8 AS y, x - 10 AS x, sample, value FROM e WHERE y >= 8 AND y < 200 AND x >= 10 AND x < 50), size AS (SELECT 192 AS h, 40 AS w), {bilinear_sql('w', 16, 16)}")
def window_resample(spark, sf_dir):
    return pixels.resampled(pixels.within(e(spark, sf_dir), WINDOW), WINDOW.width, WINDOW.height, 16, 16, "bilinear")


# --- colour ------------------------------------------------------------------------------


def rgb(rows: DataFrame, three: tuple[Column, ...]) -> DataFrame:
    return rows.select("y", "x", *(c.cast("long").alias(n) for c, n in zip(three, ("r", "g", "b"), strict=False)))


@query(f"WITH {E8_SQL} SELECT y, x, v AS r, v AS g, v AS b FROM (SELECT y, x, trunc(256 - value::DOUBLE / 256 * 256)::BIGINT % 256 AS v FROM e8)")
def rgb_white_is_zero(spark, sf_dir):
    return rgb(e8(spark, sf_dir), colour.from_white_is_zero(F.col("value"), 256))


@query(f"WITH {E8_SQL} SELECT y, x, v AS r, v AS g, v AS b FROM (SELECT y, x, trunc(value::DOUBLE / 255 * 256)::BIGINT % 256 AS v FROM e8)")
def rgb_black_is_zero(spark, sf_dir):
    return rgb(e8(spark, sf_dir), colour.from_black_is_zero(F.col("value"), 255))


@query("""SELECT vec_id AS y, 0::BIGINT AS x, trunc(m[label + 1]::DOUBLE / 65536 * 256)::BIGINT AS r, trunc(m[label + 9]::DOUBLE / 65536 * 256)::BIGINT AS g, trunc(m[label + 17]::DOUBLE / 65536 * 256)::BIGINT AS b
FROM (SELECT vec_id, label, list_transform(range(0, 24), lambda i: (i * 7919) % 65536) AS m FROM embeddings) WHERE label < 8
UNION ALL SELECT vec_id, 0, CASE label WHEN 8 THEN (8 * 7919 % 65536) * 256 // 65536 ELSE (9 * 7919 % 65536) * 256 // 65536 END,
CASE label WHEN 8 THEN (16 * 7919 % 65536) * 256 // 65536 ELSE (17 * 7919 % 65536) * 256 // 65536 END, 0 FROM embeddings WHERE label >= 8""")
def rgb_palette(spark, sf_dir):
    """A map of 8 colours; labels 8 and 9 have no blue entry."""
    colours = F.array(*(F.lit(i * 7919 % 65536) for i in range(24)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.lit(0).cast("long").alias("x"), "label")
    return rgb(rows, colour.from_palette(F.col("label"), colours))


@query(f"WITH {G_SQL} SELECT y, x, " + ", ".join(f"trunc(255 * ((255 - b{i}::DOUBLE) / 256) * ((255 - b3::DOUBLE) / 256))::BIGINT AS {n}" for i, n in enumerate("rgb")) + " FROM g")
def rgb_cmyk(spark, sf_dir):
    return rgb(g(spark, sf_dir), colour.from_cmyk(*(F.col(f"b{i}") for i in range(4))))


@query(f"""WITH {G_SQL}, d AS (SELECT y, x, b0::DOUBLE AS l, b1::DOUBLE - 128 AS cb, b2::DOUBLE - 128 AS cr FROM g)
SELECT y, x, round_even(greatest(0, least(255, l + 1.402::DOUBLE * cr)), 0)::BIGINT AS r,
round_even(greatest(0, least(255, l - 0.34414::DOUBLE * cb - 0.71414::DOUBLE * cr)), 0)::BIGINT AS g, round_even(greatest(0, least(255, l + 1.772::DOUBLE * cb)), 0)::BIGINT AS b FROM d""")
def rgb_ycbcr(spark, sf_dir):
    return rgb(g(spark, sf_dir), colour.from_y_cb_cr(F.col("b0"), F.col("b1"), F.col("b2")))


@query(f"""WITH {G_SQL}, s AS (SELECT y, x, (b0::DOUBLE % 101 + 16) / 116 AS fy, (CASE WHEN b1 >= 128 THEN b1 - 256 ELSE b1 END)::DOUBLE AS a, (CASE WHEN b2 >= 128 THEN b2 - 256 ELSE b2 END)::DOUBLE AS b FROM g),
f AS (SELECT y, x, a / 500 + fy AS fx, fy, fy - b / 200 AS fz FROM s),
t AS (SELECT y, x, 0.95047::DOUBLE * CASE WHEN fx * fx * fx > 0.008856::DOUBLE THEN fx * fx * fx ELSE (fx - 16::DOUBLE / 116) / 7.787::DOUBLE END AS cx,
  CASE WHEN fy * fy * fy > 0.008856::DOUBLE THEN fy * fy * fy ELSE (fy - 16::DOUBLE / 116) / 7.787::DOUBLE END AS cy,
  1.08883::DOUBLE * CASE WHEN fz * fz * fz > 0.008856::DOUBLE THEN fz * fz * fz ELSE (fz - 16::DOUBLE / 116) / 7.787::DOUBLE END AS cz FROM f),
l AS (SELECT y, x, cx * 3.2406::DOUBLE + cy * -1.5372::DOUBLE + cz * -0.4986::DOUBLE AS r, cx * -0.9689::DOUBLE + cy * 1.8758::DOUBLE + cz * 0.0415::DOUBLE AS g, cx * 0.0557::DOUBLE + cy * -0.204::DOUBLE + cz * 1.057::DOUBLE AS b FROM t)
SELECT y, x, """ + ", ".join(f"trunc(round(greatest(0, least(1, CASE WHEN {c} > 0.0031308::DOUBLE THEN 1.055::DOUBLE * pow(abs({c}), 1::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE ELSE 12.92::DOUBLE * {c} END)) * 255, 6))::BIGINT // 4 AS {c}" for c in "rgb") + " FROM l")
def rgb_cielab(spark, sf_dir):
    """To a step of 4, as powers differ in their last bits from one library to another."""
    out = rgb(g(spark, sf_dir), colour.from_cie_lab(F.col("b0") % 101, F.col("b1"), F.col("b2")))
    return out.select("y", "x", *(F.floor(F.col(c) / 4).alias(c) for c in "rgb"))


@query(f"WITH {G_SQL} SELECT y, x, b0 AS r, b1 AS g, b2 AS b, b3 AS a FROM g")
def rgb_alpha(spark, sf_dir):
    out = colour.to_rgb(2, [F.col(f"b{i}") for i in range(4)], 256, alpha=True)
    return g(spark, sf_dir).select("y", "x", *(c.alias(n) for c, n in zip(out, "rgba", strict=True)))


# --- predictors, packed samples, conversions ---------------------------------------------


def predicted(bits: int) -> tuple[str, Callable]:
    sql = f"WITH {E8_SQL} SELECT y, x, sample, ((sum(value * {1 << bits - 8}) OVER (PARTITION BY y, sample ORDER BY x ROWS UNBOUNDED PRECEDING)) % {1 << bits})::BIGINT AS value FROM e8"

    def run(spark, sf_dir):
        rows = e8(spark, sf_dir).withColumn("value", F.col("value") * (1 << bits - 8))
        return pixels.horizontal(rows, bits)

    run.__name__ = f"predictor_horizontal_{bits}"
    return sql, run


for _bits in (8, 16, 32):
    _sql, _run = predicted(_bits)
    query(_sql)(_run)


@query(f"""WITH {E8_SQL}, c AS (SELECT y, x AS i, value FROM e8 WHERE x < 64), s AS (SELECT y, i, ((sum(value) OVER (PARTITION BY y, i % 2 ORDER BY i ROWS UNBOUNDED PRECEDING)) % 256)::BIGINT AS value FROM c)
SELECT y, (i % 16) // 2 AS x, ((i % 16) % 2)::INTEGER AS sample, (i // 16)::INTEGER AS byte, value FROM s""")
def predictor_float(spark, sf_dir):
    """64 bytes a row: 8 pixels of 2 samples of 4 bytes."""
    coded = e8(spark, sf_dir).where("x < 64").select("y", F.col("x").alias("i"), "value")
    return pixels.floating(coded, 8, 2, 4)


@query(f"""WITH {G_SQL}, l AS (SELECT y, x, unnest([b0, b1, b2]) AS value, unnest(range(0, 3))::INTEGER AS sample FROM g)
SELECT y, x, sample, ((sum(value) OVER (PARTITION BY y, sample, x // 16 ORDER BY x ROWS UNBOUNDED PRECEDING)) % 256)::BIGINT AS value FROM l""")
def predictor_planar(spark, sf_dir):
    """Each band of its own, in tiles 16 wide."""
    return pixels.horizontal(long_form(g(spark, sf_dir), 3), 8, block_width=16)


def unpack_sql(bits: int, count: int) -> str:
    """Over the 32 characters of an md5: their bits as a string, cut."""
    return f"""WITH d AS (SELECT doc_id AS y, list_aggregate(list_transform(string_split(md5(text), ''), lambda c: lpad(bin(ascii(c)), 8, '0')), 'string_agg', '') AS s FROM documents),
p AS (SELECT y, unnest(range(0, {count}))::BIGINT AS x, s FROM d)
SELECT y, x, list_sum(list_transform(range(0, {bits}), lambda i: (substr(s, x * {bits} + i + 1, 1) = '1')::BIGINT * (1 << ({bits} - 1 - i))::BIGINT))::BIGINT AS value FROM p"""


def unpack_query(bits: int, count: int):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("y"), F.encode(F.md5("text"), "utf-8").alias("data"))
        return pixels.unpacked(rows, bits, count)

    run.__name__ = f"unpack_bits_{bits}"
    query(unpack_sql(bits, count))(run)


for _bits, _count in ((1, 256), (4, 64), (12, 21)):
    unpack_query(_bits, _count)


@query(f"WITH {E8_SQL} SELECT y, x, CASE WHEN value % 16 >= 8 THEN value % 16 - 16 ELSE value % 16 END AS value FROM e8")
def sign_extend(spark, sf_dir):
    return e8(spark, sf_dir).select("y", "x", values.sign_extended(F.col("value") % 16, 4).alias("value"))


@query(f"WITH {E_SQL} SELECT y, x, ((trunc(value * 10000)::BIGINT % 256) + 256) % 256 AS value FROM e")
def touint8_wrap(spark, sf_dir):
    return e(spark, sf_dir).select("y", "x", values.to_uint8(F.col("value") * 10000).alias("value"))


@query(f"WITH {E_SQL} SELECT y, x, round_even(greatest(0, least(255, value * 1000)), 0)::BIGINT AS value FROM e")
def touint8_clamp(spark, sf_dir):
    return e(spark, sf_dir).select("y", "x", values.to_uint8_clamp(F.col("value") * 1000).alias("value"))


# --- georeferencing ----------------------------------------------------------------------

GEO_SQL = """im AS (SELECT p_partkey AS image_id, (p_partkey % 50 + 10)::BIGINT AS width, (p_size + 5)::BIGINT AS height, p_partkey::DOUBLE AS ox, p_retailprice AS oy, (p_size + 1) / 8.0::DOUBLE AS sx, (p_size + 3) / 4.0::DOUBLE AS sy, p_partkey % 3 AS kind FROM part)"""


def geo_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind 0: tie point and scale. Kind 1: a straight matrix. Kind 2: a turned one."""
    d = lambda v: F.lit(float(v))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 50 + 10).cast("long").alias("width"), (F.col("p_size") + 5).cast("long").alias("height"), F.col("p_partkey").cast("double").alias("ox"), F.col("p_retailprice").alias("oy"), ((F.col("p_size") + 1) / d(8)).alias("sx"), ((F.col("p_size") + 3) / d(4)).alias("sy"), (F.col("p_partkey") % 3).alias("kind"))
    ox, oy, sx, sy, kind = (F.col(c) for c in ("ox", "oy", "sx", "sy", "kind"))
    straight = F.array(sx, d(0), d(0), ox, d(0), -sy, d(0), oy, d(0), d(0), d(1), d(0), d(0), d(0), d(0), d(1))
    turned = F.array(sx, sy, d(0), ox, sy, -sx, d(0), oy, d(0), d(0), d(1), d(0), d(0), d(0), d(0), d(1))
    return p.select("image_id", "width", "height", F.when(kind == 0, F.array(d(0), d(0), d(0), ox, oy, d(0))).alias("tiepoint"), F.when(kind == 0, F.array(sx, sy, d(0))).alias("pixel_scale"), F.when(kind == 1, straight).when(kind == 2, turned).alias("transform"))


@query(f"WITH {GEO_SQL} SELECT image_id, ox AS origin_x, oy AS origin_y, CASE WHEN kind = 2 THEN sqrt(sx * sx + sy * sy) ELSE sx END AS res_x, CASE kind WHEN 0 THEN -sy WHEN 1 THEN sy ELSE -sqrt(sy * sy + sx * sx) END AS res_y FROM im")
def affine_origin_resolution(spark, sf_dir):
    o, r = georeference.origin(), georeference.resolution()
    return geo_images(spark, sf_dir).select("image_id", o[0].alias("origin_x"), o[1].alias("origin_y"), r[0].alias("res_x"), r[1].alias("res_y"))


@query(f"WITH {GEO_SQL} SELECT image_id, least(ox, ox + sx * width) AS x0, least(oy, oy + -sy * height) AS y0, greatest(ox, ox + sx * width) AS x1, greatest(oy, oy + -sy * height) AS y1 FROM im WHERE kind = 0")
def affine_bbox(spark, sf_dir):
    box = georeference.bounding_box()
    return geo_images(spark, sf_dir).where("pixel_scale is not null").select("image_id", *(box[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"""WITH {GEO_SQL} SELECT image_id, least(ox, ox + sy * height, ox + sx * width, ox + sx * width + sy * height) AS x0, least(oy, oy + -sx * height, oy + sy * width, oy + sy * width + -sx * height) AS y0,
greatest(ox, ox + sy * height, ox + sx * width, ox + sx * width + sy * height) AS x1, greatest(oy, oy + -sx * height, oy + sy * width, oy + sy * width + -sx * height) AS y1 FROM im WHERE kind = 2""")
def affine_bbox_rotated(spark, sf_dir):
    box = georeference.bounding_box()
    return geo_images(spark, sf_dir).where("transform is not null and transform[1] <> 0").select("image_id", *(box[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"""WITH {GEO_SQL}, w AS (SELECT image_id, floor((10.5::DOUBLE - ox) / sx + 0.5)::BIGINT AS xa, floor((90.25::DOUBLE - ox) / sx + 0.5)::BIGINT AS xb, floor((20.5::DOUBLE - oy) / -sy + 0.5)::BIGINT AS ya, floor((70.0::DOUBLE - oy) / -sy + 0.5)::BIGINT AS yb FROM im WHERE kind = 0)
SELECT image_id, least(xa, xb) AS x0, least(ya, yb) AS y0, greatest(xa, xb) AS x1, greatest(ya, yb) AS y1 FROM w""")
def bbox_to_window(spark, sf_dir):
    rows = geo_images(spark, sf_dir).where("pixel_scale is not null").withColumn("origin", georeference.origin()).withColumn("resolution", georeference.resolution())
    w = georeference.pixel_window(F.array(*(F.lit(v) for v in (10.5, 20.5, 90.25, 70.0))))
    return rows.select("image_id", w.alias("w")).select("image_id", *(F.col(f"w.{n}").cast("long").alias(n) for n in ("x0", "y0", "x1", "y1")))


@query("""WITH im AS (SELECT s_suppkey AS file_id, k::INTEGER AS image_id, (1000 + s_suppkey * 8) >> k AS width, (800 + s_suppkey * 4) >> k AS height FROM supplier, range(0, 5) t(k)),
f AS (SELECT *, 3.0::DOUBLE > 1200 / width OR 2.5::DOUBLE > 900 / height AS fits FROM (SELECT file_id, image_id, width::DOUBLE AS width, height::DOUBLE AS height FROM im))
SELECT file_id, coalesce(arg_min(image_id, width) FILTER (fits), arg_max(image_id, width)) AS image_id FROM f GROUP BY file_id""")
def best_fit_overview(spark, sf_dir):
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("image_id"))
    halved = lambda n: F.floor(n / F.pow(F.lit(2.0), F.col("image_id"))).cast("long")
    images = images.withColumn("width", halved(1000 + F.col("file_id") * 8)).withColumn("height", halved(800 + F.col("file_id") * 4))
    images = images.withColumn("box", F.array(*(F.lit(v) for v in (0.0, 0.0, 1200.0, 900.0)))).withColumn("subfile", F.lit(2)).withColumn("new_subfile", F.lit(1))
    return georeference.overview(georeference.candidates(images), 3.0, 2.5, ["file_id"])


@query("""WITH f AS (SELECT n_nationkey AS file_ord, count(*)::BIGINT AS images FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
o AS (SELECT file_ord, images, coalesce(sum(images) OVER (ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM f)
SELECT file_ord, i AS image_id, first + i AS global_id FROM o, LATERAL (SELECT unnest(range(0, images)) AS i)""")
def multi_file_index(spark, sf_dir):
    from pyspark.sql.window import Window as Over

    files = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("file_ord")).agg(F.count(F.lit(1)).alias("images"))
    before = Over.orderBy("file_ord").rowsBetween(Over.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("images").over(before), F.lit(0).cast("long")))
    return placed.select("file_ord", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("images") - 1)).alias("i", "image_id"), "first").select("file_ord", "image_id", (F.col("first") + F.col("image_id")).alias("global_id"))


@query("SELECT c_custkey AS place, (c_custkey * 37 % 5000)::BIGINT AS byte_count, (1000 + coalesce(sum(c_custkey * 37 % 5000) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\", c_nationkey FROM customer")
def writer_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("place"), (F.col("c_custkey") * 37 % 5000).cast("long").alias("byte_count"))
    return pixels.offsets(rows, ["c_nationkey"])


# --- strings, arrays, maps ---------------------------------------------------------------


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN c_custkey::DOUBLE WHEN 2 THEN c_custkey::DOUBLE / 4 WHEN 3 THEN c_custkey::DOUBLE WHEN 4 THEN NULL ELSE -c_custkey::DOUBLE END::DOUBLE AS number FROM customer""")
def js_number_parse(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, "  ").when(k % 6 == 1, k.cast("string")).when(k % 6 == 2, F.concat(F.lit(" "), (k / 4.0).cast("string"))).when(k % 6 == 3, F.concat(F.lit("0x"), F.hex(k))).when(k % 6 == 4, "inf").otherwise(F.concat(F.lit("-"), k.cast("string"), F.lit("e0")))
    number = values.js_number(text)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(~F.isnan(number), number).alias("number"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE END AS nodata FROM customer")
def gdal_nodata_parse(spark, sf_dir):
    """The last character goes, then the text is read as a number."""
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit("\0"))).otherwise("nanx")
    number = values.js_number(F.expr("substring(raw, 1, length(raw) - 1)"))
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", F.when(~F.isnan(number), number).alias("nodata"))


@query("SELECT c_custkey, ((c_custkey % 5 + 2) // 3)::INTEGER AS chunks, CASE WHEN c_custkey % 5 > 0 THEN [c_custkey + i for i in range(0, c_custkey % 5)][1] END AS first, CASE WHEN c_custkey % 5 > 0 THEN (3 - (c_custkey % 5) % 3) % 3 ELSE 0 END::INTEGER AS padding FROM customer")
def util_chunk(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", collections.times(F.col("c_custkey") % 5, lambda i: F.col("c_custkey") + i).alias("a"))
    parts = collections.chunk(F.col("a"), 3)
    return rows.select("c_custkey", F.size(parts).alias("chunks"), F.get(F.get(parts, F.lit(0)), F.lit(0)).alias("first"), F.size(F.filter(F.flatten(parts), lambda v: v.isNull())).alias("padding"))


@query("SELECT c_custkey, i AS place, c_custkey + i AS a, CASE WHEN i < 2 THEN c_custkey * 10 + i END AS b FROM customer, range(0, 3) t(i)")
def util_zip(spark, sf_dir):
    k = F.col("c_custkey")
    pairs = collections.zipped(F.array(k, k + 1, k + 2), F.array(k * 10, k * 10 + 1))
    return table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(pairs).alias("i", "p")).select("c_custkey", F.col("i").cast("long").alias("place"), "p.a", "p.b")


@query("SELECT c_custkey, 'v' || c_custkey AS key, 'a' AS value FROM customer UNION ALL SELECT c_custkey, 'w', 'c' FROM customer")
def util_invert(spark, sf_dir):
    k = F.concat(F.lit("v"), F.col("c_custkey").cast("string"))
    m = F.create_map(F.lit("a"), k, F.lit("b"), F.lit("w"), F.lit("c"), F.lit("w"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(collections.inverted(m)))


@query("SELECT c_custkey, 'a' AS key, c_custkey AS value FROM customer UNION ALL SELECT c_custkey, 'b', c_custkey + 1 FROM customer UNION ALL SELECT c_custkey, 'c', 3 FROM customer")
def util_assign(spark, sf_dir):
    k = F.col("c_custkey")
    m = collections.assigned(F.create_map(F.lit("a"), k, F.lit("b"), k), F.create_map(F.lit("b"), k + 1, F.lit("c"), F.lit(3).cast("long")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(m))


@query("SELECT c_custkey, c_custkey * 10 AS first, c_custkey * 10 + 9 AS last, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 100 END AS size FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer WHERE c_custkey % 3 = 0")
def content_range_parse(spark, sf_dir):
    k = F.col("c_custkey")
    size = F.when(k % 2 == 0, (k * 100).cast("string")).otherwise("*")
    header = F.when(k % 3 != 0, F.concat(F.lit("bytes "), (k * 10).cast("string"), F.lit("-"), (k * 10 + 9).cast("string"), F.lit("/"), size)).otherwise("bytes none")
    return table(spark, sf_dir, "customer").select("c_custkey", collections.content_range(header).alias("r")).select("c_custkey", "r.first", "r.last", "r.size")


# --- codecs and files --------------------------------------------------------------------

ROUND_SQL = "SELECT doc_id, octet_length(encode(text))::BIGINT AS size, sha256(text) AS digest FROM documents"


def round_trip(name: str, compression: int):
    def run(spark, sf_dir):
        import pyarrow as pa

        from tessel.sources.codecs import ENCODERS, get_decoder

        def both(batches):
            for batch in batches:
                data = [None if t is None else ENCODERS[compression](t.encode()) for t in batch.column(1).to_pylist()]
                out = [None if d is None else get_decoder(compression)(d) for d in data]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "data"])

        rows = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(both, "doc_id long, data binary")
        return rows.select("doc_id", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("digest"))

    run.__name__ = f"{name}_roundtrip"
    query(ROUND_SQL)(run)


for _name, _id in (("raw", 1), ("lzw", 5), ("deflate", 8), ("packbits", 32773), ("zstd", 50000)):
    round_trip(_name, _id)


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of each row of E: 64 x 1 pixels of doubles."""
    from tessel.operators import dataset

    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("path"), F.size("embedding").alias("width"), F.lit(1).alias("height"), F.lit(1).alias("samples"), F.col("embedding").cast("array<double>").alias("values"))
    return dataset.written(rows, ["path"])


@query(f"WITH {E_SQL} SELECT 'e' || y AS path, x, value FROM e")
def writer_roundtrip(spark, sf_dir):
    """Rows of E written as files, and their pixels read from the files' bytes."""
    import numpy as np
    import pyarrow as pa

    from tessel.operators.dataset import from_bytes

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                (band,) = from_bytes(content.as_py()).image(0).read_rasters()
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * band.size), pa.array(np.arange(band.size)), pa.array(band.ravel())], names=["path", "x", "value"])

    return strips(spark, sf_dir).mapInArrow(run, "path string, x long, value double")


@query("SELECT 'e' || vec_id AS path, t.tag::INTEGER AS tag, t.name AS name, t.value::DOUBLE AS value FROM embeddings, LATERAL (SELECT unnest([256, 257, 258, 259, 262, 277, 278, 279, 284, 339]) AS tag, unnest(['ImageWidth', 'ImageLength', 'BitsPerSample', 'Compression', 'PhotometricInterpretation', 'SamplesPerPixel', 'RowsPerStrip', 'StripByteCounts', 'PlanarConfiguration', 'SampleFormat']) AS name, unnest([len(embedding), 1, 64, 1, 1, 1, 1, len(embedding) * 8, 1, 3]) AS value) t")
def ifd_tags(spark, sf_dir):
    from tessel.operators import dataset

    rows = dataset.ifd_tags(strips(spark, sf_dir))
    return rows.where(F.col("tag").isin(256, 257, 258, 259, 262, 277, 278, 279, 284, 339)).select("path", "tag", "name", F.col("value.numbers")[0].alias("value"))


@query("SELECT 'e' || vec_id AS path, k.key_id::INTEGER AS key_id, k.name AS name, CASE k.key_id WHEN 1024 THEN '2' WHEN 2048 THEN '4326' ELSE 'WGS 84' END AS value FROM embeddings, LATERAL (SELECT unnest([1024, 2048, 2049]) AS key_id, unnest(['GTModelTypeGeoKey', 'GeographicTypeGeoKey', 'GeogCitationGeoKey']) AS name) k")
def geo_keys(spark, sf_dir):
    from tessel.operators import dataset

    value = F.coalesce(F.col("value.text"), F.col("value.numbers")[0].cast("long").cast("string"))
    return dataset.geo_keys(strips(spark, sf_dir)).select("path", "key_id", "name", value.alias("value"))


@query("SELECT 'e' || vec_id AS path, 0 AS image_id, len(embedding)::BIGINT AS width, 1::BIGINT AS height, 1 AS spp, false AS tiled, -180.0::DOUBLE AS origin_x, 90.0::DOUBLE AS origin_y, 360::DOUBLE / len(embedding) AS res_x FROM embeddings")
def open_images(spark, sf_dir):
    """The table of images of files, and georeferencing over it."""
    from tessel.operators import dataset

    o, r = georeference.origin(), georeference.resolution()
    return dataset.images(strips(spark, sf_dir)).select("path", "image_id", "width", "height", "spp", "tiled", o[0].alias("origin_x"), o[1].alias("origin_y"), r[0].alias("res_x"))


def stored_raster(spark: SparkSession, sf_dir: str, tags: dict) -> str:
    """E as one file of its rows' number of rows, in the folder that all executors share (a temporary one where none is set); the file's path."""
    import tempfile
    import uuid

    from tessel.operators import dataset

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="rasters-")
    folder = shared.removeprefix("file:").replace("///", "/").rstrip("/")
    name = f"raster-{uuid.uuid4().hex}.tif"
    rows = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / ROWS_OF_A_FILE).alias("part"))
    cells = rows.agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))  # no more than ROWS_OF_A_FILE rows
    values = F.flatten(F.transform("r", lambda x: x["embedding"])).cast("array<double>")
    made = cells.select(F.concat(F.col("part").cast("string"), F.lit("-" + name)).alias("path"), F.size(F.col("r")[0]["embedding"]).alias("width"), F.size("r").alias("height"), F.lit(1).alias("samples"), values.alias("values"))
    dataset.stored(dataset.written(made, ["path"], tags=tags), folder, "path").write.format("noop").mode("overwrite").save()
    return f"{folder}/*-{name}"


ROWS_OF_A_FILE = 64


@query(f"WITH {E_SQL} SELECT y, x, value FROM e WHERE x BETWEEN 10 AND 49 AND y % 64 BETWEEN 5 AND 39")
def raster_scan(spark, sf_dir):
    """E written as files of 64 rows, and a window of each read by spark.read.format("raster"): only blocks that meet the window."""
    from tessel.operators import dataset

    found = dataset.pixels_of(dataset.tiles(spark, stored_raster(spark, sf_dir, {"RowsPerStrip": 16}), pixels.Window(10, 5, 50, 40)))
    part = F.regexp_extract("path", r"/(\d+)-raster-[^/]*$", 1).cast("long")
    return found.where((F.col("x") >= 10) & (F.col("x") < 50) & (F.col("y") >= 5) & (F.col("y") < 40)).select((part * ROWS_OF_A_FILE + F.col("y")).alias("y"), "x", "value")


@query(f"WITH {E_SQL} SELECT y // 64 AS part, 0 AS image_id, count(DISTINCT x)::BIGINT AS width, count(DISTINCT y)::BIGINT AS height, least(16, count(DISTINCT y))::BIGINT AS block_h FROM e GROUP BY 1")
def raster_directories(spark, sf_dir):
    """The images of the same files, by ranges of their directories only."""
    from tessel.operators import dataset

    found = dataset.images(dataset.files(spark, stored_raster(spark, sf_dir, {"RowsPerStrip": 16})))
    return found.select(F.regexp_extract("path", r"/(\d+)-raster-[^/]*$", 1).cast("long").alias("part"), "image_id", "width", "height", F.col("block_h"))
