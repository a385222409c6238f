"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; a temporary one of this machine where it's unset and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or tempfile.mkdtemp(prefix="checkpoint-")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that is made and run inside go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """df with a unique long for each row.

    The same table read again gives the same ids, as they follow from the order of
    the files and of the rows in them. So df has to be a scan, not the result of a
    shuffle.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def words(text: Column) -> Column:
    """How many words text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def named(value: Column, function) -> Column:
    """function of value, which is computed once however often function uses it, also inside lambdas."""
    return F.transform(F.array(value), function)[0]
