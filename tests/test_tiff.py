"""Files: writer, parser, codecs, predictors, packed samples, reading; numbers are known results."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.errors import ImageIndexError, RasterError
from tessel.functions import dictionary
from tessel.operators import arrays
from tessel.operators.dataset import Dataset, from_bytes
from tessel.operators.writer import WriterError, write, write_blocks
from tessel.plans.pixels import Window
from tessel.sources import codecs, tiff
from tessel.sources.readers import BlockedReader, CachedReader, MemoryReader

ROUND = [np.uint8, np.int8, np.uint16, np.int16, np.uint32, np.int32, np.float32, np.float64, np.uint64, np.int64]


@pytest.mark.parametrize("dtype", ROUND)
def test_write_then_read(dtype):
    data = (np.arange(24) - (5 if np.dtype(dtype).kind != "u" else 0)).astype(dtype)
    file = from_bytes(write(data, width=4, height=3))
    out = file.image(0).read_rasters()
    assert [a.dtype for a in out] == [np.dtype(dtype)] * 2
    assert np.array_equal(np.stack(out, -1).ravel(), data)
    assert file.image(0).geo_keys == {1024: 2, 2048: 4326, 2049: "WGS 84"}
    assert file.image(0).origin() == [-180, 90, 0]
    assert file.image(0).resolution() == [90, -60, 0]


def test_large_integers_stay_exact():
    data = np.array([9007199254740993, 2**64 - 1], np.uint64)
    image = from_bytes(write(data, width=2, height=1)).image(0)
    assert image.read_rasters()[0].tolist() == [[9007199254740993, 2**64 - 1]]
    assert image.read_rasters(width=4, method="nearest")[0].tolist()[0][0] == 9007199254740993


def test_nested_numbers_are_bytes_with_room_for_eight():
    raw = write([[[1, 2, 3]], [[4, 5, 6]]])
    assert len(raw) == 1000 + 6 * 8
    out = from_bytes(raw).image(0).read_rasters()
    assert [a.ravel().tolist() for a in out] == [[1, 2, 3], [4, 5, 6]]


def test_writer_sizes_and_errors():
    assert len(write(np.arange(4, dtype=np.int16), width=2, height=2)) == 1008
    with pytest.raises(WriterError):
        write(np.array([], np.uint8), width=1, height=1)
    with pytest.raises(WriterError):
        write(np.arange(4, dtype=np.uint8), width=2)
    with pytest.raises(WriterError):
        write(np.arange(5, dtype=np.uint8), width=2, height=2)
    with pytest.raises(WriterError):
        write(np.arange(4, dtype=np.uint8), {"TileByteCounts": [4]}, width=2, height=2)


def test_photometric_zero_is_taken_for_missing():
    tags = from_bytes(write(np.arange(12, dtype=np.uint8), {"PhotometricInterpretation": [0]}, width=2, height=2)).ifd(0)
    assert tags.photometric == 2


@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 50000])
@pytest.mark.parametrize("block", [None, (16, 16)])
@pytest.mark.parametrize("big", [False, True])
def test_tiles_strips_codecs_predictor(compression, block, big):
    r = np.random.default_rng(3)
    bands = [r.integers(0, 1000, (37, 51)).astype(np.uint16) for _ in range(3)]
    for little in (True, False):
        raw = write_blocks(bands, block, compression, 2, 2, little, big=big)
        file = from_bytes(raw)
        assert file.is_big_tiff() == big
        out = file.image(0).read_rasters(samples=[2, 0])
        assert np.array_equal(out[0], bands[2]) and np.array_equal(out[1], bands[0])
        part = file.image(0).read_rasters(window=Window(-2, 30, 20, 40), samples=[1], fill=9)[0]
        assert (part[:, :2] == 9).all() and (part[7:] == 9).all()
        assert np.array_equal(part[:7, 2:], bands[1][30:37, :20])


def test_only_blocks_of_the_window_are_fetched():
    raw = write_blocks([np.zeros((64, 64), np.uint8)], (16, 16))
    asked = []

    def fetch(offset, size):
        asked.append((offset, size))
        return raw[offset : offset + size]

    image = Dataset([fetch]).image(0)
    asked.clear()
    image.read_rasters(window=Window(0, 0, 17, 16))
    assert len(asked) == 2


def test_known_resampling():
    a = np.array([[1.0, 2], [3, 4]])
    assert arrays.nearest(a, 4, 4).tolist() == [[1, 2, 2, 2], [3, 4, 4, 4], [3, 4, 4, 4], [3, 4, 4, 4]]
    assert arrays.bilinear(a, 4, 4).tolist() == [[1, 1.5, 2, 2], [2, 2.5, 3, 3], [3, 3.5, 4, 4], [3, 3.5, 4, 4]]
    with pytest.raises(RasterError, match="Unsupported resampling method: 'Cubic'"):
        arrays.resampled([a], 3, 3, "Cubic")


def test_known_predictors():
    out, _ = codecs.unpredicted(bytes([10, 20, 5, 5, 5, 5, 1, 2, 1, 1, 1, 1]), 2, 3, 2, [8, 8], 2, "<")
    assert list(out) == [10, 20, 15, 25, 20, 30, 1, 2, 2, 3, 3, 4]
    assert list(codecs.unpredicted(bytes([200, 100]), 2, 2, 1, [8], 1, "<")[0]) == [200, 44]
    out, order = codecs.unpredicted(bytes([10, 5, 5, 5, 1, 1, 1, 1, 0, 0, 0, 0, 2, 3, 1, 0]), 3, 4, 1, [32], 1, "<")
    assert order == ">" and list(np.frombuffer(out, "u1").reshape(4, 4)[:, ::-1].ravel()) == [31, 29, 26, 10, 34, 29, 27, 15, 35, 29, 28, 20, 35, 29, 29, 25]


def test_known_codecs():
    assert codecs.packbits(bytes([2, 10, 20, 30])) == bytes([10, 20, 30])
    assert codecs.packbits(bytes([0xFD, 99])) == bytes([99] * 4)
    assert codecs.lzw(bytes([32, 144, 96, 68, 34, 20, 22, 2])) == b"AAAABBBB"
    with pytest.raises(RasterError, match="old style JPEG"):
        codecs.get_decoder(6)(b"")
    with pytest.raises(RasterError, match="Unknown compression method identifier: 77"):
        codecs.get_decoder(77)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.binary(max_size=20).map(lambda b: b * 200))
def test_codecs_are_exact(data):
    for c, encode in codecs.ENCODERS.items():
        assert codecs.get_decoder(c)(encode(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 16), st.integers(1, 9), st.integers(1, 4), st.data())
def test_packed_samples(bits, width, height, data):
    values = data.draw(st.lists(st.integers(0, 2**bits - 1), min_size=width * height, max_size=width * height))
    rows = b""
    for y in range(height):
        text = "".join(format(v, f"0{bits}b") for v in values[y * width : (y + 1) * width])
        text += "0" * (-len(text) % 8)
        rows += int(text, 2).to_bytes(len(text) // 8, "big")
    (out,) = codecs.unpacked(rows, width, height, [bits], [1], ">")
    if bits not in (8, 16):
        assert out.ravel().tolist() == values
    (signed,) = codecs.unpacked(rows, width, height, [bits], [2], ">")
    assert [v % 2**bits for v in signed.ravel().tolist()] == out.ravel().tolist()


def test_readers():
    data = bytes(range(256)) * 10
    asked = []

    def fetch(offset, size):
        asked.append((offset, size))
        return data[offset : offset + size]

    for reader in (MemoryReader(data), BlockedReader(fetch, 100, 3), CachedReader(fetch, 500)):
        for offset, size in ((0, 10), (95, 10), (2550, 50), (0, 700), (3000, 5)):
            assert reader(offset, size) == data[offset : offset + size]
    asked.clear()
    blocked = BlockedReader(fetch, 100, 10)
    blocked(0, 350)
    blocked(50, 100)
    assert asked == [(0, 400)]


def test_header_errors():
    for raw, text in ((b"XX\0\0\0\0\0\0", "byte order"), (b"II\x01\0\0\0\0\0", "magic"), (b"II\x2b\0\x04\0\0\0", "offset byte-size"), (b"II\x2b\0\x08\0\x01\0", "reserved"), (b"II", "outside the bounds")):
        with pytest.raises(RasterError, match=text):
            tiff.parse(MemoryReader(raw))
    loop = b"II\x2a\0" + struct.pack("<I", 8) + struct.pack("<H", 0) + struct.pack("<I", 8)
    with pytest.raises(RasterError, match="Cycle"):
        tiff.parse(MemoryReader(loop))
    file = from_bytes(write(np.zeros(1, np.uint8), width=1, height=1))
    with pytest.raises(ImageIndexError, match="No image at index 4"):
        file.image(4)
    with pytest.raises(RasterError, match="Invalid sample index '1'"):
        file.image(0).read_rasters(samples=[1])
    with pytest.raises(RasterError, match="Invalid subsets"):
        Window(2, 0, 1, 1)


def overview_pair() -> Dataset:
    place = {33922: (12, [0.0, 0, 0, 0, 0, 0]), 33550: (12, [1.0, 1, 0])}
    raw = write_blocks([np.full((4, 4), 0x11, np.uint8)], None, more=place, overviews=[[np.full((2, 2), 0x22, np.uint8)]])
    return from_bytes(raw)


@pytest.mark.parametrize(("request_", "shape", "value"), [({"res_x": 3}, (2, 2), 0x22), ({"res_x": 0.5}, (4, 4), 0x11), ({"width": 1}, (2, 1), 0x22), ({"bbox": [1, -3, 3, -1]}, (2, 2), 0x11)])
def test_best_fit(request_, shape, value):
    (out,) = overview_pair().read_rasters_best_fit(**request_)
    assert out.shape == shape and (out == value).all()


def test_best_fit_errors():
    file = overview_pair()
    with pytest.raises(RasterError, match='Both "bbox" and "window" passed.'):
        file.read_rasters_best_fit(bbox=[0, 0, 1, 1], window=Window(0, 0, 1, 1))
    with pytest.raises(RasterError, match="Both width and resX passed"):
        file.read_rasters_best_fit(width=1, res_x=1)
    with pytest.raises(RasterError, match="affine"):
        from_bytes(write_blocks([np.zeros((2, 2), np.uint8)])).read_rasters_best_fit()


def test_many_files_one_index():
    one = MemoryReader(write(np.zeros(1, np.uint8), width=1, height=1))
    two = MemoryReader(write_blocks([np.ones((2, 2), np.uint8)], overviews=[[np.ones((1, 1), np.uint8)]]))
    file = Dataset([one, two])
    assert file.image_count() == 3 and [file.image(i).width for i in range(3)] == [1, 2, 1]


def test_empty_blocks_are_nodata():
    tags = {"SamplesPerPixel": [1], "TileWidth": [2], "TileLength": [2], "TileByteCounts": [4, 0], "GDAL_NODATA": "7"}
    image = from_bytes(write(np.arange(1, 9, dtype=np.uint8), tags, width=4, height=2)).image(0)
    assert image.nodata == 7
    assert image.read_rasters()[0].tolist() == [[1, 2, 7, 7], [3, 4, 7, 7]]


def test_js_numbers():
    assert [tiff.number(t) for t in ("", " 0x10 ", "-Infinity", "1e3", "-0.5")] == [0, 16, float("-inf"), 1000, -0.5]
    assert all(np.isnan(tiff.number(t)) for t in ("inf", "nan", "1_0", "x"))


def test_dictionary():
    assert len(dictionary.TAGS) == 116 and len(dictionary.GEO_KEYS) == 47
    assert dictionary.tag_name(60000) == "Tag60000" and dictionary.resolve_tag("ImageWidth") == 256
    dictionary.register_tag(60001, "Mine", "SHORT")
    assert dictionary.get_tag("Mine")[0] == 60001
    assert dictionary.geo_key_id("GTModelTypeGeoKey") == 1024 and dictionary.geo_key_name(1) is None


def test_rgb():
    grey = [np.array([[0, 1, 127, 255]], np.uint8)]
    assert arrays.to_rgb(0, grey, 255)[0].tolist() == [[0, 254, 128, 0]]
    assert arrays.to_rgb(1, grey, 255)[0].tolist() == [[0, 1, 127, 0]]
    assert [a.tolist() for a in arrays.to_rgb(3, [np.array([[-1.0, 1.5, 99, np.nan]])], 256, [1] * 6)] == [[[0] * 4]] * 3
    assert arrays.to_rgb(5, [np.array([[v]]) for v in (0, 0, 0, 255)], 256)[0].tolist() == [[0]]
    assert arrays.clamped(np.array([-5, 300, 127.4, 127.6, 2.5, 3.5, np.nan])).tolist() == [0, 255, 127, 128, 2, 4, 0]
    with pytest.raises(RasterError, match="photometric"):
        arrays.to_rgb(4, grey, 256)
