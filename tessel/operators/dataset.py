"""Opening rasters, and what can be read from them.

tiles() and the tables of images, tags, keys and blocks are DataFrames; read_rasters() and
read_rgb() put one window of one image together and return its arrays, as a caller of a
raster library expects. Work over many images or large ones goes through DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.errors import ImageIndexError, RasterError
from tessel.functions.dictionary import ExtraSamples
from tessel.operators import arrays
from tessel.plans.georeference import NO_AFFINE, best_fit
from tessel.plans.pixels import Window
from tessel.sources import blocks, tiff
from tessel.sources.codecs import Decoder, array_type, needs_normalization
from tessel.sources.readers import BlockedReader, CachedReader, HttpOptions, MemoryReader, ObjectReader, open_reader


@dataclass
class Image:
    directory: tiff.Directory
    fetch: tiff.Fetch
    first: tiff.Directory | None = None
    decoders: dict[int, Decoder] = field(default_factory=dict)

    def __getattr__(self, name: str):
        return getattr(self.directory, name)

    @property
    def tile_width(self) -> int:
        return self.directory.block_width

    @property
    def tile_height(self) -> int:
        return self.directory.block_height

    def sample_format(self, sample: int = 0) -> int:
        return self.directory.formats[self.checked(sample)]

    def bits_per_sample(self, sample: int = 0) -> int:
        return self.directory.bits[self.checked(sample)]

    def sample_byte_size(self, sample: int = 0) -> int:
        return -(-self.bits_per_sample(sample) // 8)

    def checked(self, sample: int) -> int:
        if not 0 <= sample < self.directory.samples:
            raise RasterError(f"Invalid sample index '{sample}'.")
        return sample

    def array_for_sample(self, sample: int, size: int) -> np.ndarray:
        return np.zeros(size, array_type(self.sample_format(sample), self.bits_per_sample(sample)))

    def needs_normalization(self, sample: int = 0) -> bool:
        return needs_normalization(self.sample_format(sample), self.bits_per_sample(sample))

    def tie_points(self) -> list[dict[str, float]]:
        values = self.directory.numbers("ModelTiepoint") or []
        if len(values) % 6:
            raise RasterError("The tie points are not groups of six numbers")
        return [dict(zip("ijkxyz", values[a : a + 6], strict=True)) for a in range(0, len(values), 6)]

    def origin(self) -> list[float]:
        t, m = self.directory.numbers("ModelTiepoint"), self.directory.numbers("ModelTransformation")
        if t and len(t) == 6:
            return t[3:]
        if m is not None:
            long_enough("ModelTransformation", m, 12)
            return [m[3], m[7], m[11]]
        raise RasterError(NO_AFFINE)

    def resolution(self, reference: Image | None = None) -> list[float]:
        s, m = self.directory.numbers("ModelPixelScale"), self.directory.numbers("ModelTransformation")
        if s is not None:
            long_enough("ModelPixelScale", s, 3)
            return [s[0], -s[1], s[2]]
        if m is not None:
            long_enough("ModelTransformation", m, 11)
            return [m[0], -m[5], m[10]] if m[1] == 0 and m[4] == 0 else [math.hypot(m[0], m[4]), -math.hypot(m[1], m[5]), m[10]]
        if reference is not None:
            r = reference.resolution()
            return [r[0] * reference.width / self.width, r[1] * reference.height / self.height, r[2] * reference.width / self.width]
        raise RasterError(NO_AFFINE)

    def bounding_box(self, tilegrid: bool = False) -> list[float]:
        m, w, h = self.directory.numbers("ModelTransformation"), self.width, self.height
        if not tilegrid and m and len(m) >= 8:
            corners = [(m[3] + m[0] * i + m[1] * j, m[7] + m[4] * i + m[5] * j) for i, j in ((0, 0), (0, h), (w, 0), (w, h))]
        else:
            o, r = self.origin(), self.resolution()
            corners = [(o[0], o[1]), (o[0] + r[0] * w, o[1] + r[1] * h)]
        xs, ys = zip(*corners, strict=True)
        return [min(xs), min(ys), max(xs), max(ys)]

    def pixel_is_area(self) -> bool:
        return self.directory.geo_keys.get(1025) == 1

    def get_tile_or_strip(self, x: int, y: int, sample: int = 0, decoders: dict[int, Decoder] | None = None) -> blocks.Block:
        if not self.directory.tiled and x:
            raise RasterError("Strips have no column but 0")
        return blocks.decoded(self.directory, self.fetch, x, y, self.checked(sample) if self.directory.planar == 2 else -1, self.decoders | (decoders or {}))

    def read_rasters(self, window: Window | None = None, samples: list[int] | None = None, interleave: bool = False, width: int | None = None, height: int | None = None, method: str = "nearest", fill: float | list[float] | None = None, decoders: dict[int, Decoder] | None = None):
        """Arrays (height, width) for each sample; interleaved, one array (height, width, samples) of the image's widest type."""
        d = self.directory
        window = window or Window.full(d.width, d.height)
        wanted = [self.checked(s) for s in samples or range(d.samples)]
        if interleave and isinstance(fill, list):
            raise RasterError("When reading interleaved data, fillValue must be a single number.")
        own = self.decoders | (decoders or {})
        read = (blocks.decoded(d, self.fetch, *place, own) for place in blocks.places(d, window, wanted))
        out = blocks.stitched(d, read, window, wanted, fill)
        if interleave:
            kind = np.dtype(blocks.widest(d))
            out = [a.astype(kind) for a in out]
        out = arrays.resampled(out, width, height, method)
        return np.stack(out, -1) if interleave else out

    def read_rgb(self, window: Window | None = None, interleave: bool = True, width: int | None = None, height: int | None = None, method: str = "nearest", alpha: bool = False, decoders: dict[int, Decoder] | None = None):
        """Red, green and blue (and more, of an RGB image with alpha, if wanted); resampled before colours are converted."""
        d = self.directory
        kind = d.photometric
        if kind not in (0, 1, 2, 3, 5, 6, 8):
            raise RasterError("Invalid or unsupported photometric interpretation.")
        extra = d.first("ExtraSamples", 0)
        every = kind == 2 and alpha and extra != ExtraSamples.UNSPECIFIED
        count = {0: 1, 1: 1, 3: 1, 5: 4}.get(kind, 3)
        wanted = list(range(d.samples)) if every else list(range(count))
        found = self.read_rasters(window, wanted, False, width, height, method, None, decoders)
        out = arrays.to_rgb(kind, found, 2.0 ** d.bits[0], d.numbers("ColorMap"), every)
        return np.stack(out, -1) if interleave else out

    def summary(self) -> dict:
        d = self.directory
        try:
            place = {"origin": self.origin(), "resolution": self.resolution(), "bbox": self.bounding_box()}
        except RasterError:
            place = {"origin": None, "resolution": None, "bbox": None}
        return place | {"width": d.width, "height": d.height, "subfile": d.first("SubfileType"), "new_subfile": d.first("NewSubfileType", 0)}


class Dataset:
    """One file, or a main file and overview files behind one index of images."""

    def __init__(self, fetches: list[tiff.Fetch], decoders: dict[int, Decoder] | None = None):
        self.fetches = fetches
        self.files = [tiff.parse(f) for f in fetches]
        self.decoders = decoders or {}

    def image_count(self) -> int:
        return sum(len(f) for f in self.files)

    def is_big_tiff(self) -> bool:
        return bool(self.files[0]) and self.files[0][0].big

    def locate(self, index: int) -> tuple[int, int]:
        at = index
        for n, found in enumerate(self.files):
            if 0 <= at < len(found):
                return n, at
            at -= len(found)
        raise ImageIndexError(index)

    def ifd(self, index: int) -> tiff.Directory:
        n, at = self.locate(index)
        return self.files[n][at]

    def image(self, index: int = 0) -> Image:
        n, at = self.locate(index)
        return Image(tiff.image(self.files[n], at), self.fetches[n], self.ifd(0), self.decoders)

    def get_slice(self, offset: int, size: int | None = None) -> bytes:
        return self.fetches[0](offset, size or (4048 if self.is_big_tiff() else 1024))

    def ghost_values(self) -> dict[str, str] | None:
        return tiff.ghost(self.fetches[0], self.is_big_tiff())

    def read_rasters(self, index: int = 0, **options):
        return self.image(index).read_rasters(**options)

    def read_rgb(self, index: int = 0, **options):
        return self.image(index).read_rgb(**options)

    def read_rasters_best_fit(self, window: Window | None = None, bbox: list[float] | None = None, width: int | None = None, height: int | None = None, res_x: float | None = None, res_y: float | None = None, **options):
        every = [self.image(i).summary() for i in range(self.image_count())]
        index, chosen = best_fit(every, window, bbox, width, height, res_x, res_y)
        return self.image(index).read_rasters(window=chosen, width=width, height=height, **options)

    def close(self) -> None:
        self.fetches, self.files = [], []


def long_enough(tag: str, values: list, least: int) -> None:
    if len(values) < least:
        raise RasterError(f"{tag} has {len(values)} values; at least {least} are required")


def from_reader(fetch: tiff.Fetch, decoders: dict[int, Decoder] | None = None) -> Dataset:
    return Dataset([CachedReader(fetch)], decoders)


def from_bytes(data: bytes, decoders: dict[int, Decoder] | None = None) -> Dataset:
    return Dataset([MemoryReader(data)], decoders)


from_array_buffer = from_blob = from_bytes
from_custom_client = from_reader


def from_file(path: str, decoders: dict[int, Decoder] | None = None) -> Dataset:
    return from_reader(open_reader(path), decoders)


def from_url(url: str, options: HttpOptions | None = None, decoders: dict[int, Decoder] | None = None) -> Dataset:
    return from_reader(open_reader(url, options), decoders)


def from_urls(main: str, overviews: list[str], options: HttpOptions | None = None, decoders: dict[int, Decoder] | None = None) -> Dataset:
    """The files are opened side by side, and stay in the order given."""
    with ThreadPoolExecutor(8) as pool:
        return Dataset(list(pool.map(lambda p: CachedReader(open_reader(p, options)), (main, *overviews))), decoders)


def from_object(spark: SparkSession, path: str, decoders: dict[int, Decoder] | None = None) -> Dataset:
    """A file of an object store, by ranges; of a store that only Spark reads, whole."""
    try:
        return from_reader(ObjectReader(path), decoders)
    except (ValueError, NotImplementedError):  # a scheme that is none of pyarrow's
        return from_bytes(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), decoders)


def from_source(source, **options) -> Dataset:
    if isinstance(source, (bytes, bytearray)):
        return from_bytes(bytes(source), **options)
    return from_reader(source, **options) if isinstance(source, Callable) else from_file(source, **options)


# --- tables ------------------------------------------------------------------------------

VALUE = "struct<text:string,numbers:array<double>,is_array:boolean>"


def files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """path and size of files, from any store that Spark lists; with content their bytes too, which images() and its like don't need: they read a file's directories by ranges."""
    return spark.read.format("binaryFile").load(path).select("path", "content" if content else F.col("length").alias("size"))


def described(found: DataFrame, rows: Callable[[list[tiff.Directory]], list[tuple]], schema: str) -> DataFrame:
    """found: path, and content if it is at hand. One pass over files, each giving rows; schema is of what follows path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = to_arrow_schema(StructType.fromDDL(f"path string, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                fetch = MemoryReader(batch.column(1)[i].as_py()) if held else BlockedReader(open_reader(path))
                data = [(path, *r) for r in rows(tiff.parse(fetch))]
                if data:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*data, strict=True), full, strict=True)], schema=full)

    held = "content" in found.columns
    return found.select("path", *(["content"] if held else [])).mapInArrow(run, f"path string, {schema}")


IMAGES = "image_id int, width long, height long, spp int, bits array<int>, formats array<int>, photometric int, compression int, predictor int, planar int, tiled boolean, block_w long, block_h long, little_endian boolean, big boolean, nodata double, tiepoint array<double>, pixel_scale array<double>, transform array<double>, subfile int, new_subfile int"


def images(found: DataFrame) -> DataFrame:
    def rows(every: list[tiff.Directory]) -> list[tuple]:
        return [(i, d.width, d.height, d.samples, d.bits, d.formats, d.photometric, d.compression, d.predictor, d.planar, d.tiled, d.block_width, d.block_height, d.order == "<", d.big, d.nodata, d.numbers("ModelTiepoint"), d.numbers("ModelPixelScale"), d.numbers("ModelTransformation"), d.first("SubfileType"), d.first("NewSubfileType")) for i, d in enumerate(every)]

    return described(found, rows, IMAGES)


def ifd_tags(found: DataFrame) -> DataFrame:
    def rows(every: list[tiff.Directory]) -> list[tuple]:
        return [(i, t.tag, t.name, t.field_type, t.count, {"text": t.value if isinstance(t.value, str) else None, "numbers": None if isinstance(t.value, str) else [float(v) for v in t.value], "is_array": t.is_array}) for i, d in enumerate(every) for t in d.tags.values()]

    return described(found, rows, f"image_id int, tag int, name string, field_type int, count long, value {VALUE}")


def geo_keys(found: DataFrame) -> DataFrame:
    from tessel.functions.dictionary import geo_key_name

    def rows(every: list[tiff.Directory]) -> list[tuple]:
        return [(i, k, geo_key_name(k), {"text": v if isinstance(v, str) else None, "numbers": None if isinstance(v, str) else [float(n) for n in np.atleast_1d(v)], "is_array": isinstance(v, list)}) for i, d in enumerate(every) for k, v in d.geo_keys.items()]

    return described(found, rows, f"image_id int, key_id int, name string, value {VALUE}")


def tiles(spark: SparkSession, path: str, window: Window | None = None, samples: list[int] | None = None, image: int | str = 0, decoders: dict[int, str] | None = None) -> DataFrame:
    """Decoded blocks that a window meets, by the data source: pruned before any task starts. decoders: names (module:function) by compression."""
    from tessel.sources.datasource import register

    register(spark)
    reader = spark.read.format("raster").option("paths", path).option("image", str(image))
    if window:
        reader = reader.option("window", f"{window.x0},{window.y0},{window.x1},{window.y1}")
    if samples:
        reader = reader.option("samples", ",".join(map(str, samples)))
    if decoders:
        reader = reader.option("decoders", ",".join(f"{c}={name}" for c, name in decoders.items()))
    return reader.load()


def pixels_of(found: DataFrame) -> DataFrame:
    """tiles() as rows path, image_id, y, x, sample, value (double): the way from the tile plane to the pixel plane."""
    each = found.select("path", "image_id", "x0", "y0", "w", F.explode(F.arrays_zip("samples", "dtypes", "bands")).alias("b")).select("path", "image_id", "x0", "y0", "w", "b.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["bands"], np.dtype(r["dtypes"]).newbyteorder("<")).astype(np.float64)
                i = np.arange(len(v))
                columns = [pa.array([r["path"]] * len(v)), pa.array(np.full(len(v), r["image_id"], np.int32)), pa.array(r["y0"] + i // r["w"]), pa.array(r["x0"] + i % r["w"]), pa.array(np.full(len(v), r["samples"], np.int32)), pa.array(v)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "image_id", "y", "x", "sample", "value"])

    return each.mapInArrow(run, "path string, image_id int, y long, x long, sample int, value double")


def written(rasters: DataFrame, keys: list[str], width: str = "width", height: str = "height", tags: dict | None = None) -> DataFrame:
    """rasters: keys, width, height, samples, values (array<double>, pixel by pixel). Each row as the bytes of a file of 64-bit floats: keys, content."""
    from tessel.operators.writer import write

    schema = ", ".join(f"{k} {rasters.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for batch in batches:
            made = [write(np.array(r[3].as_py(), np.float64), {"SamplesPerPixel": r[2].as_py()} | (tags or {}), width=r[0].as_py(), height=r[1].as_py()) for r in zip(*(batch.column(n + i) for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.binary())], names=[*keys, "content"])

    return rasters.select(*keys, width, height, "samples", "values").mapInArrow(run, f"{schema}, content binary")


def stored(made: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Writes each content as a file of its name into a folder that the executors reach; returns the names and sizes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            for n, c in zip(batch.column(0), batch.column(1), strict=True):
                path = os.path.join(folder, n.as_py())
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(c.as_py())
                os.replace(part, path)  # whole or not at all, also when a task is done again
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.binary_length(batch.column(1)).cast(pa.int64())], names=["name", "size"])

    return made.select(name, "content").mapInArrow(run, "name string, size long")
