"""Rasters as they arrive: new files of a folder, decoded by the same functions as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.operators import dataset

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """A stream of path, content; stateless, so it scales with the files of a trigger."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def images(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """The images of arriving files."""
    return dataset.images(arriving(spark, folder, pattern))
