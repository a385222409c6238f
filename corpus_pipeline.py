"""From raw documents to a mix for training, in stages that each call one operator.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; each one's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import decontamination, mixing, quality, secrets, simhash
from tessel.llm.common import shared_folder

STAGES = [
    ("quality_classifier", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontamination.stage),
    ("secret_scans", secrets.stage),
    ("mixing", mixing.stage),
]

#: SQL can't express the classifier nor the hashes of the near duplicates: tests hold the stages against brute force.
ORACLE_SQL = None


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    at = folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
