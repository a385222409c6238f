"""Every query of the raster engine against its SQL on the smallest tables, and known numbers of the pixel plane."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel import catalogue
from tessel.errors import RasterError
from tessel.functions import colour, values
from tessel.operators import dataset
from tessel.operators.writer import write_blocks
from tessel.plans import pixels
from tessel.plans.pixels import Window

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return ""
    return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(tuple(map(str, map(plain, r))) for r in found.select(*columns).collect())
    want = duck.execute(catalogue.SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert mine == sorted(tuple(str(plain(r[i])) for i in at) for r in want.fetchall())


def raster(spark, rows):
    data = [(y, x, 0, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(data, "y long, x long, sample int, value double")


def grid_of(df):
    rows = df.orderBy("y", "x").collect()
    w = max(r["x"] for r in rows) + 1
    return [[r["value"] for r in rows][i : i + w] for i in range(0, len(rows), w)]


def test_known_resampling(spark):
    a = raster(spark, [[1, 2], [3, 4]])
    assert grid_of(pixels.resampled(a, 2, 2, 4, 4)) == [[1, 2, 2, 2], [3, 4, 4, 4], [3, 4, 4, 4], [3, 4, 4, 4]]
    assert grid_of(pixels.resampled(a, 2, 2, 4, 4, "bilinear")) == [[1, 1.5, 2, 2], [2, 2.5, 3, 3], [3, 3.5, 4, 4], [3, 3.5, 4, 4]]
    assert pixels.resampled(a, 2, 2, None, 0) is a
    with pytest.raises(RasterError, match="Unsupported resampling method: 'Lanczos'"):
        pixels.resampled(a, 2, 2, 3, 3, "Lanczos")


@pytest.mark.parametrize(("w", "h"), [(1, 1), (3, 7), (5, 2), (11, 13)])
def test_planes_agree(spark, w, h):
    from tessel.operators import arrays

    a = np.random.default_rng(w).normal(size=(6, 5))
    for method in ("nearest", "bilinear"):
        (want,) = arrays.resampled([a], w, h, method)
        assert np.array_equal(np.array(grid_of(pixels.resampled(raster(spark, a.tolist()), 5, 6, w, h, method))), want)


def test_fill_outside(spark):
    a = raster(spark, [[1, 2], [3, 4]])
    assert grid_of(pixels.filled(a, Window(-1, -1, 2, 2), 1, 9)) == [[9, 9, 9], [9, 1, 2], [9, 3, 4]]
    assert grid_of(pixels.filled(a, Window(5, 5, 7, 6), 1, float("nan"))) == [[0, 0]]


def test_conversions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first()["v"]

    assert [value(values.to_uint8(F.lit(v))) for v in (255.9, 256.0, -1.0, float("nan"), float("inf"))] == [255, 0, 255, 0, 0]
    assert [value(values.to_uint8_clamp(F.lit(v))) for v in (-5.0, 300.0, 127.4, 127.6, 2.5, 3.5, float("nan"))] == [0, 255, 127, 128, 2, 4, 0]
    assert [value(values.js_round(F.lit(v))) for v in (-1.5, -1.6, 1.5)] == [-1, -2, 2]
    assert [value(values.js_number(F.lit(v))) for v in ("", " 0x10 ", "-Infinity", "0b11", "1e2")] == [0, 16, float("-inf"), 3, 100]
    assert all(np.isnan(value(values.js_number(F.lit(v)))) for v in ("inf", "nan", "1x"))
    assert value(values.stored(F.lit(200.0), "int8")) == -56
    assert value(values.range_sum(F.array(*map(F.lit, (1, 2, 3))), 1, 3)) == 5
    assert [c for c in one.select(*colour.from_palette(F.lit(1.5), F.array(*[F.lit(5)] * 6))).first()] == [0, 0, 0]
    with pytest.raises(RasterError, match="photometric"):
        colour.to_rgb(4, [F.lit(1)], 256)


def test_plans_push_down(spark):
    plan = catalogue.window_read(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,8)" in plan and "label" not in plan
    assert "Exchange" not in plan


def test_data_source(spark, tmp_path):
    r = np.random.default_rng(1)
    bands = [r.integers(0, 255, (40, 50)).astype(np.uint8) for _ in range(2)]
    path = str(tmp_path / "a.tif")
    Path(path).write_bytes(write_blocks(bands, (16, 16), 8, 2))
    window = Window(10, 5, 20, 30)
    found = dataset.tiles(spark, path, window)
    assert found.count() == 4
    got = pixels.within(dataset.pixels_of(found), window)
    rows = {(p["y"], p["x"], p["sample"]): p["value"] for p in got.collect()}
    assert len(rows) == 10 * 25 * 2
    assert all(rows[y, x, s] == bands[s][y + 5, x + 10] for y in range(25) for x in range(10) for s in range(2))
    images = dataset.images(dataset.files(spark, path)).first()
    assert (images["width"], images["height"], images["spp"], images["tiled"]) == (50, 40, 2, True)
    assert dataset.from_object(spark, path).image(0).read_rasters()[1].tolist() == bands[1].tolist()


def test_stream_of_files(spark, tmp_path):
    from tessel.streaming import files

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tif").write_bytes(write_blocks([np.zeros((4, 6), np.uint8)]))
    run = files.images(spark, str(folder)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r["width"], r["height"]) for r in spark.sql("select * from arrived").collect()] == [(6, 4)]
