"""Readers against a server on this machine, object paths, and the data source's options."""

from __future__ import annotations

import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.errors import RasterError
from tessel.functions import collections
from tessel.operators import arrays, dataset
from tessel.operators.writer import write
from tessel.plans import georeference
from tessel.plans.pixels import Window
from tessel.sources import codecs, readers

DATA = bytes(np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8))


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *args):
        pass

    def do_GET(self):
        state = self.server.state
        state["asked"].append(self.headers.get("Range"))
        data, mode = state["data"], state["mode"]
        ranges = [(int(a), min(int(b) + 1, len(data))) for a, b in re.findall(r"(\d+)-(\d+)", self.headers.get("Range", ""))]
        if mode == "full":
            return self.answer(200, data, {})
        if all(a >= len(data) for a, _ in ranges):
            return self.answer(416, b"", {"Content-Range": f"bytes */{len(data)}"})
        if len(ranges) == 1 or mode == "one":
            a, b = min(a for a, _ in ranges), max(b for _, b in ranges)
            shift = 1 if mode == "shifted" else 0
            total = len(data) + len(state["asked"]) if mode == "growing" else len(data)
            return self.answer(206, data[a:b], {"Content-Range": f"bytes {a + shift}-{b - 1 + shift}/{total}"})
        body = b"preamble\r\n" if mode == "preamble" else b""
        for a, b in ranges:
            if a < b:
                body += f"--edge\r\nContent-Type: x/y\r\nContent-Range: bytes {a}-{b - 1}/{len(data)}\r\n\r\n".encode() + data[a:b] + b"\r\n"
        self.answer(206, body + b"--edge--\r\n", {"Content-Type": 'multipart/byteranges; boundary="edge"'})

    def answer(self, status, body, headers):
        self.send_response(status)
        for k, v in (headers | {"Content-Length": str(len(body))}).items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def server():
    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    http.state = {"data": DATA, "mode": "", "asked": []}
    threading.Thread(target=http.serve_forever, daemon=True).start()
    http.url = f"http://127.0.0.1:{http.server_port}/a.tif"
    yield http
    http.shutdown()
    http.server_close()


RANGES = [(5, 100), (250_000, 1000), (299_990, 100), (400_000, 5)]


@pytest.mark.parametrize("most", [0, 2, 16])
@pytest.mark.parametrize("mode", ["", "one", "preamble"])
def test_ranges(server, most, mode):
    server.state["mode"] = mode
    fetch = readers.HttpReader(server.url, readers.HttpOptions(max_ranges=most))
    assert fetch.many(RANGES) == [DATA[a : a + n] for a, n in RANGES]
    assert fetch(10, 20) == DATA[10:30] and fetch(500_000, 5) == b"" and fetch.size == len(DATA)


def test_blocks_are_asked_for_together(server):
    fetch = readers.BlockedReader(readers.HttpReader(server.url, readers.HttpOptions(max_ranges=8)), 10_000)
    fetch(0, 10), fetch(50_000, 10)
    assert fetch(0, 95_000) == DATA[:95_000]
    assert server.state["asked"][2:] == ["bytes=10000-49999,60000-99999"]


def test_answers_that_are_refused(server):
    fetch = readers.HttpReader(server.url)
    server.state["mode"] = "full"
    with pytest.raises(RasterError, match="full file"):
        fetch(0, 10)
    assert readers.HttpReader(server.url, readers.HttpOptions(allow_full_file=True, max_ranges=4)).many(RANGES) == [DATA[a : a + n] for a, n in RANGES]
    server.state["mode"] = "shifted"
    with pytest.raises(RasterError, match="Content-Range"):
        fetch(0, 10)
    server.state["mode"] = "growing"
    fetch(0, 10)
    with pytest.raises(RasterError, match="size"):
        fetch(0, 10)
    for body, edge in ((b"", "edge"), (b"--edge--", ""), (b"--edge\r\nno colon\r\n\r\n", "edge"), (b"--edge\r\nContent-Range: bytes 0-9/20\r\n\r\nabc\r\n--edge--", "edge"), (b"--edge\r\nContent-Range: bytes 0-2/20\r\n\r\nabc\r\n", "edge")):
        with pytest.raises(RasterError):
            list(readers.byte_ranges(body, edge))


def image_bytes(n=48):
    return write(np.arange(n * n, dtype=np.float64), {"RowsPerStrip": 8}, width=n, height=n)


def test_a_file_by_http(spark, server):
    server.state["data"] = image_bytes()
    (band,) = dataset.from_url(server.url).image(0).read_rasters(window=Window(3, 9, 20, 30))
    assert np.array_equal(band.reshape(21, 17), np.arange(48 * 48.0).reshape(48, 48)[9:30, 3:20])
    found = dataset.pixels_of(dataset.tiles(spark, server.url, Window(0, 10, 48, 12))).where("y = 10 and x = 7").collect()
    assert [r["value"] for r in found] == [10 * 48 + 7.0]
    both = dataset.from_urls(server.url, [server.url])
    assert both.image_count() == 2


def test_object_paths(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(image_bytes())
    url = f"file://{tmp_path}/a.tif"
    fetch = readers.ObjectReader(url)
    assert fetch(8, 100) == image_bytes()[8:108] and fetch(10**6, 5) == b""
    assert dataset.from_object(spark, url).image(0).width == 48
    with pytest.raises(ValueError):
        readers.ObjectReader("ftp://x/y")
    assert isinstance(readers.open_reader("s3a://bucket/a.tif"), readers.ObjectReader)
    found = dataset.images(dataset.files(spark, str(tmp_path)))
    assert "content" not in dataset.files(spark, str(tmp_path)).columns and [(r["width"], r["block_h"]) for r in found.collect()] == [(48, 8)]
    assert dataset.ifd_tags(dataset.files(spark, str(tmp_path))).count() == dataset.ifd_tags(dataset.files(spark, str(tmp_path), content=True)).count()


def flipped(data: bytes) -> bytes:
    return bytes(255 - b for b in data)


def test_decoders_of_the_data_source(spark, tmp_path):
    data = np.arange(256, dtype=np.uint8)
    (tmp_path / "a.tif").write_bytes(write(255 - data, {"Compression": 60001}, width=16, height=16))
    with pytest.raises(Exception, match="60001"):
        dataset.tiles(spark, str(tmp_path / "a.tif")).collect()
    found = dataset.tiles(spark, str(tmp_path / "a.tif"), decoders={60001: "tests.test_sources:flipped"}).collect()
    assert found[0]["bands"][0] == data.tobytes()


def test_small_rules(spark):
    assert [codecs.needs_normalization(f, b) for f, b in ((1, 8), (1, 24), (2, 24), (2, 12), (3, 16), (3, 64), (3, 24), (1, 64))] == [False, False, False, True, False, False, True, True]
    assert codecs.zeros_for_type(5, 3).shape == (6,) and codecs.zeros_for_type(12, 3).dtype == np.float64
    with pytest.raises(RasterError):
        codecs.zeros_for_type(99, 1)
    assert arrays.of_new_size(np.zeros(3, np.int16), 4, 5, 2).dtype == np.int16
    image = dataset.from_bytes(write(np.zeros(4, np.uint8), {"ModelPixelScale": [1.0, 2.0]}, width=2, height=2)).image(0)
    with pytest.raises(RasterError, match="ModelPixelScale has 2 values; at least 3 are required"):
        image.resolution()
    d = image.directory
    assert d.indexed("ModelPixelScale", 1) == 2.0 and d.indexed("ModelPixelScale", 2) is None and len(d) == len(list(d)) and d.tags[256].whole() == [2]
    del d.tags[258]
    assert d.bits == [0]
    with pytest.raises(RasterError, match="Unsupported data format"):
        image.read_rasters()
    row = spark.createDataFrame([("bytes 0-9/20", "bytes 5-2/20", "bytes 0-9/*", "a.tif", [1.0, 2.0], ["A: b", "C:d", "a: z"])], "a string, b string, c string, d string, pixel_scale array<double>, h array<string>").withColumn("transform", F.lit(None).cast("array<double>"))
    got = row.select(*(collections.strict_content_range(F.col(c)).alias(c) for c in "abc"), collections.ends_with(F.col("d"), F.lit(".tif")).alias("d"), collections.header_map(F.col("h")).alias("h")).first()
    assert tuple(got["a"]) == (0, 9, 20) and got["b"] is None and got["c"] is None and got["d"] and got["h"] == {"a": "z", "c": "d"}
    with pytest.raises(Exception, match="at least 3 are required"):
        row.select(georeference.resolution().alias("r")).collect()
