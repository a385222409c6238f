"""Operator 8: mixing sources to target weights by capped water-filling.

Each source has a weight, and the mix a size in words. Every source's share rises in
proportion to its weight until it has EPOCHS times its own words; what it can't take the
others share by weight, until none is above its bound. That fixed point is a water level
L with target = min(EPOCHS * size, weight * L), and windows over the table of sources
(one row each) find it.

A source whose target is r times its words takes floor(r) whole repetitions of each
document, and of the rest documents in a seeded order, until the target is met: the
document at the edge gives only as many words as are missing. So the words taken meet the
target to within a word, and with the same seed reruns agree.

The order is by a hash of doc_id. Its first three digits are bins: sums over bins give
where each bin begins, and only within a bin are documents put in order, so that no task
has a whole source. Rows alike in doc_id, source and size are counted first and dealt out
again at the end. Null text has size 0, a null source is one of its own, ordered last; a
null doc_id is ordered as ''. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import table, words

EPOCHS = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)
SEED = "17"


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes: one row per source with source, words, weight. Adds target (double).

    Sources fill up in the order of bound over weight. Were the first k of them full, the
    level of the others would be what is left over their weights; it is the true one for
    the first k at which the next source does not overflow, and less for any later k.
    """
    order = Window.orderBy(F.col("words") * epochs / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    zero = F.lit(0).cast("long")
    level = (F.sum("words").over(everything) * share - F.coalesce(F.sum("words").over(before), zero) * epochs) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    )
    tried = sizes.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("words") * epochs, F.col("level"))
    found = tried.withColumn("level", F.coalesce(F.max(fits).over(everything), F.lit(0.0)))
    return found.withColumn("target", F.least((F.col("words") * epochs).cast("double"), F.col("level") * F.col("weight"))).drop("level")


def cycled(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources with weights in turn, in code point order, null last."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), turn + 1))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    alike = (
        docs.select("doc_id", "source", words(F.col("text")).alias("size"))
        .withColumn("key", key)
        .groupBy("doc_id", "source", "size", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin", F.substring("key", 1, 3))
    )
    bins = alike.groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("n")).alias("in_bin"))
    sources = targets(cycled(bins.groupBy("source").agg(F.sum("in_bin").alias("words"))))
    begins = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = bins.select("source", "bin", F.coalesce(F.sum("in_bin").over(begins), zero).alias("bin_begin")).join(
        sources.select(F.col("source").alias("s"), "words", "target"), F.col("source").eqNullSafe(F.col("s"))
    )
    within = Window.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("in_front", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), zero)).join(
        starts.select(F.col("source").alias("s"), F.col("bin").alias("b"), "bin_begin", "words", "target"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")),
    )
    whole: Column = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(zero)
    part = F.round(F.col("target") - F.col("words") * whole).cast("long")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    begin = F.col("bin_begin") + F.col("in_front") + F.col("copy") * F.col("size")
    rest = F.greatest(zero, F.least(F.col("size"), part - begin))
    return each.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", (F.col("size") * whole + rest).cast("long").alias("taken"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of docs: what each document gives to it, in words."""
    return mixed(docs)


SQL = r"""
WITH alike AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS words,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) - 1) % 3] AS weight
  FROM alike GROUP BY source
), tried AS (
  SELECT *, ((sum(words) OVER ())::DOUBLE * 1.5::DOUBLE
             - 2 * coalesce(sum(words) OVER o, 0)::DOUBLE)
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM sizes
  WINDOW o AS (ORDER BY (words * 2)::DOUBLE / weight, source COLLATE C ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT coalesce(max(level) FILTER (level * weight <= words * 2), 0) AS level FROM tried
), sources AS (
  SELECT source, words, least((words * 2)::DOUBLE, chosen.level * weight) AS target FROM sizes, chosen
), placed AS (
  SELECT a.doc_id, a.size, s.words, s.target,
         coalesce(sum(a.size) OVER (PARTITION BY a.source ORDER BY a.key, a.doc_id NULLS FIRST, a.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin,
         CASE WHEN s.words > 0 THEN floor(s.target / s.words)::BIGINT ELSE 0 END AS whole
  FROM alike a JOIN sources s ON a.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, words AS source_size, target,
       (size * whole + greatest(0, least(size, round(target - words * whole)::BIGINT - begin)))::BIGINT AS taken
FROM placed
"""
