"""Operator 4: a quality classifier, one byte-level convolutional network for all texts.

The network (convnet.py) is fitted in the driver on a sample of at most SAMPLE labelled
documents and SAMPLE_BYTES bytes in all, short and long ones whole, sent to the executors
(its weights are 128 kB whatever the input), and scores each text whole, in one pass
without a shuffle. A very long text takes 20 bytes of memory a byte while it's scored.

Null text counts as empty and gets a score like any other. A null doc_id counts as ''
when folds are drawn. Repeated rows get the same score each. Labels that are null, or
whose document isn't there, don't take part; with no labels, or one kind only, the score
of every text is the share of label 1 (1/2 without any). Of several labels of one
document one takes part, the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import table
from tessel.llm.convnet import Convnet, fitted

#: The bound on the labelled rows that the network is fitted on, and on the bytes of all of them together.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 26
#: Documents with this score or more are kept.
THRESHOLD = 0.3
#: Bytes of text scored at once.
AT_ONCE = 1 << 21


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Convnet:
    """The network from a sample of labels outside fold 0 whose documents are there: the first by a hash, so that reruns agree."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    order = [F.xxhash64("doc_id", "text"), F.col("doc_id"), F.col("text")]
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")  # at most sample rows of two numbers
        .orderBy(*order)
        .limit(sample)
        .withColumn("bytes", so_far)  # of no more than sample rows
        .where(F.col("bytes") <= SAMPLE_BYTES)
        .collect()
    )
    return fitted([r["text"].encode() for r in rows], [int(r["quality"]) for r in rows])


def scored(docs: DataFrame, net: Convnet) -> DataFrame:
    """docs with a column score, in place of one of that name if there is one."""
    docs = docs.drop("score")
    out = docs.withColumn("score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = np.zeros(len(texts))
            part: list[bytes] = []
            size = 0
            for i in range(len(texts)):
                part.append((texts[i].as_py() or "").encode())
                size += len(part[-1])
                if size >= AT_ONCE or i == len(texts) - 1:
                    found[i + 1 - len(part) : i + 1] = net.scores(part)
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(score, out)


def classified(docs: DataFrame, net: Convnet) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return scored(docs.select("doc_id", "text"), net).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classified(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the ones that the classifier rejects; the columns stay."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    named = docs.withColumnRenamed("score", "score before") if "score" in docs.columns else docs
    return scored(named, net).where(F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)
