"""spark.read.format("raster"): blocks of TIFF files as rows.

The planner reads directories and cuts the list of blocks by the options window, samples
and image before any task starts; tasks fetch and decode only their own blocks. Options:
path or paths (comma-separated; with a scheme http, https, s3, s3a, gs, hdfs or abfs they are
read by ranges), image (default 0; "all"), window (x0,y0,x1,y1), samples (0,2,...),
blocks_per_task, decoders (50001=module:function,...: of compressions that have none here; a
function of bytes that the tasks import).

Directories of several files are read side by side. What goes to a task is a range of a
file's cut list of blocks, from which the task finds the blocks anew.
"""

from __future__ import annotations

import glob
import importlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessel.plans.pixels import Window
from tessel.sources import blocks
from tessel.sources.readers import BlockedReader, open_reader
from tessel.sources.tiff import image as image_of
from tessel.sources.tiff import parse

SCHEMA = "file_ord int, path string, image_id int, bx int, `by` int, x0 long, y0 long, w int, h int, samples array<int>, dtypes array<string>, bands array<binary>"


@dataclass
class Share(InputPartition):
    file_ord: int
    path: str
    image_id: int
    begin: int
    end: int
    window: Window | None
    samples: list[int] | None
    decoders: str


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Share]:
        o = self.options
        paths = [p for part in (o.get("paths") or o["path"]).split(",") for p in (sorted(glob.glob(part)) if "://" not in part and any(c in part for c in "*?[") else [part])]
        window = Window(*map(int, o["window"].split(","))) if o.get("window") else None
        samples = [int(s) for s in o["samples"].split(",")] if o.get("samples") else None
        step = int(o.get("blocks_per_task", 64))

        def counts(path: str) -> list[tuple[int, int]]:
            found = parse(BlockedReader(open_reader(path)))
            every = range(len(found)) if o.get("image") == "all" else [int(o.get("image", 0))]
            return [(i, sum(1 for _ in blocks.places(image_of(found, i), window, samples))) for i in every]

        with ThreadPoolExecutor(16) as pool:
            each = list(pool.map(counts, paths))
        out = [
            Share(n, path, i, a, min(count, a + step), window, samples, o.get("decoders", ""))
            for n, (path, images) in enumerate(zip(paths, each, strict=True))
            for i, count in images
            for a in range(0, count, step)
        ]
        return out or [Share(0, "", 0, 0, 0, None, None, "")]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if share.begin == share.end:
            return
        fetch = open_reader(share.path)
        image = image_of(parse(BlockedReader(fetch)), share.image_id)
        own = {}
        for part in filter(None, share.decoders.split(",")):
            compression, _, name = part.partition("=")
            module, _, function = name.partition(":")
            own[int(compression)] = getattr(importlib.import_module(module), function)
        for bx, by, sample in islice(blocks.places(image, share.window, share.samples), share.begin, share.end):
            b = blocks.decoded(image, fetch, bx, by, sample, own)
            row = [share.file_ord, share.path, share.image_id, bx, by, b.x0, b.y0, b.arrays[0].shape[1], b.arrays[0].shape[0], b.samples, [str(a.dtype) for a in b.arrays], [a.astype(a.dtype.newbyteorder("<")).tobytes() for a in b.arrays]]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.binary())]
            names = ["file_ord", "path", "image_id", "bx", "by", "x0", "y0", "w", "h", "samples", "dtypes", "bands"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
