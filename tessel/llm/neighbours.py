"""Operator 9: approximate nearest neighbours by adaptive dimension scan.

Nearness is the inner product. A vector x gets one more coordinate sqrt(M^2 - |x|^2), M
the largest norm, and a query the coordinate 0: then the nearest by distance is the
nearest by inner product. All vectors are turned by one random rotation, so that any first
d of the D coordinates are a fair sample of a distance, and dealt to the lists of a
k-means. A list is kept as blocks of columns: a scan reads COLUMNS coordinates of all of
a list's vectors at a time, and after each such block abandons the vectors whose partial
distance fails the hypothesis test

    partial > bound * d / D * (1 + EPSILON / sqrt(d))^2,

bound being the query's TOP-th best distance so far. Survivors are scored exactly, in
double precision on the vectors as given. A query left with TOP or fewer looks at all lists
without the test.

The rotation, the lists' centres and the number of lists that a query probes are fitted
in the driver on a sample of at most SAMPLE vectors (the first by a hash), every vector is
indexed. There is a list for each LIST vectors, but no more than one for each 8 of the
sample. The probes are as few as find PROBED of the sample's own neighbours; where
vectors have no clusters, as random ones, that is most lists.

Equal vectors are one, with the TOP + 1 smallest of their ids: ties go to smaller ids, so
a query needs no more of them, and each task gives on no more. Vectors of doubles stay so
for the scores; the scan works on single precision. Lists are cut into chunks of about CHUNK vectors and the
queries of a list into packs, and chunks meet packs in a join that Spark can split; so a
vector or list that holds a third of all rows is no task's alone.

Vectors that are null, zero or hold null or non-finite components take no part, neither as
queries nor as candidates, nor do rows with a null vec_id. Shorter vectors count as filled
up with zeros. Repeated rows (one vec_id and one vector) count once; rows with one vec_id
and several vectors are candidates each, and each a query of its own. A table
without queries or candidates gives an empty result. Further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessel.llm.common import checkpointed, table

EVERY, TOP = 20, 20
SAMPLE, LIST, SEED = 20_000, 1000, 5
COLUMNS, EPSILON, PROBED, SPARE = 16, 1.2, 0.97, 10
CHUNK, PACK = 2048, 2048


class Lists:
    """The fitted part: small, and sent to the executors as it is."""

    def __init__(self, sample: np.ndarray, most: float, count: int):
        draw = np.random.default_rng(SEED)
        self.dim, self.most, self.kind = sample.shape[1], most, sample.dtype
        sample = sample.astype(np.float32)
        self.rotation = np.linalg.qr(draw.normal(size=(self.dim + 1, self.dim + 1)))[0].astype(np.float32)
        turned = self.turned(sample)
        n = max(1, min(round(count / LIST), len(sample) // 8))
        self.centres = turned[draw.choice(len(turned), n, replace=False)]
        for _ in range(10):
            mine = self.nearest(turned, 1)[:, 0]
            sums = np.zeros_like(self.centres)
            np.add.at(sums, mine, turned)
            held = np.bincount(mine, minlength=n)
            self.centres[held > 0] = sums[held > 0] / held[held > 0, None]
        self.reference, self.home = turned, self.nearest(turned, 1)[:, 0]
        self.probes = self.enough(sample, draw)

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most**2 - (x.astype(np.float64) ** 2).sum(1)))
        return np.column_stack([x, last]).astype(np.float32) @ self.rotation

    def nearest(self, turned: np.ndarray, k: int) -> np.ndarray:
        far = (self.centres**2).sum(1) - 2 * turned @ self.centres.T
        return np.argsort(far, 1, kind="stable")[:, :k]

    def enough(self, sample: np.ndarray, draw: np.random.Generator) -> int:
        """The fewest probes that find PROBED of the sample's neighbours of some of the sample."""
        some = draw.choice(len(sample), min(256, len(sample)), replace=False)
        score = sample[some] @ sample.T
        score[np.arange(len(some)), some] = -np.inf
        best = np.argsort(-score, 1)[:, :TOP]
        rank = np.argsort(self.nearest(self.turned(sample[some], True), len(self.centres)), 1)
        need = np.sort(rank[np.arange(len(some))[:, None], self.home[best]].ravel())
        return int(need[min(len(need) - 1, int(np.ceil(PROBED * len(need))))]) + 1

    def bounds(self, turned: np.ndarray, near: np.ndarray) -> np.ndarray:
        """For each query the distance of its TOP + SPARE-th nearest in the sample's part of the probed lists; the lists' own TOP are nearer, and SPARE may be abandoned wrongly."""
        k = TOP + SPARE
        probed = np.zeros((len(turned), len(self.centres)), bool)
        probed[np.arange(len(turned))[:, None], near] = True
        far = (self.reference**2).sum(1) - 2 * turned @ self.reference.T + (turned**2).sum(1)[:, None]
        far[~probed[:, self.home]] = np.inf
        return np.partition(far, k, 1)[:, k] if far.shape[1] > k else np.full(len(turned), np.inf)


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def typed(embedding: Column, kind: T.DataType) -> Column:
    """embedding as single or, if it's of any other type of numbers, double precision."""
    return embedding.cast("array<float>" if isinstance(kind.elementType, T.FloatType) else "array<double>")


def named_by(embedding: Column) -> Column:
    """A vector's key: 128 bits of hashes."""
    return F.concat(F.hex(F.xxhash64(embedding)), F.hex(F.xxhash64(F.reverse(embedding), F.lit(1))))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def distinct(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """Per vector: v (a hash and the vector's key), embedding, ids (the TOP + 1 smallest), asked (whether any id is a query's)."""
    kept = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), typed(F.col("embedding"), vectors.schema["embedding"].dataType).alias("embedding"))
    keyed = kept.withColumn("v", named_by(F.col("embedding")))
    near = Window.partitionBy("v").orderBy("vec_id")  # each task passes on the first of a vector's ids only
    ids = (
        keyed.select("v", "vec_id").distinct().withColumn("place", F.row_number().over(near)).where(F.col("place") <= TOP + 1)
        .groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, TOP + 1).alias("ids"))
    )
    first = keyed.groupBy("v").agg(F.first("embedding").alias("embedding"), F.max(F.col("vec_id") % every == 0).alias("asked"))
    return first.join(ids, "v")


def fitted(nodes: DataFrame) -> Lists | None:
    count, most, dim = nodes.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))), F.max(F.size("embedding"))).first()
    if not count:
        return None
    rows = nodes.select("v", "embedding").orderBy("v").limit(SAMPLE).toArrow()
    return Lists(matrix(rows.column("embedding"), dim), most, count)


def dealt(nodes: DataFrame, queries: DataFrame, lists: Lists, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks of the lists and packs of queries, as bytes. exact: queries probe all lists, and no vector is abandoned."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mine = lists.nearest(lists.turned(matrix(b.column(1), lists.dim)), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), *b.columns], names=["list", "v", "embedding", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                turned = lists.turned(matrix(part.column(1), lists.dim), True)
                near = lists.nearest(turned, len(lists.centres) if exact else lists.probes)
                take = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                bound = np.repeat(np.full(len(turned), np.inf) if exact else lists.bounds(turned, near), near.shape[1]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), part.column(0).take(take), part.column(1).take(take), pa.array(bound)], names=["list", "v", "embedding", "bound"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    held = nodes.select("v", "embedding", "ids").mapInArrow(assign, f"list int, v string, embedding {kind}, ids array<long>")
    asked = queries.select("v", "embedding").mapInArrow(probe, f"list int, v string, embedding {kind}, bound double")

    def chunk(key: tuple, t: pa.Table) -> pa.Table:
        x = matrix(t.column("embedding"), lists.dim)
        ids = t.column("ids").to_pylist()
        sizes = np.array([len(i) for i in ids], np.int32)
        turned = np.ascontiguousarray(lists.turned(x).T)  # by columns
        flat = np.array([i for group in ids for i in group], np.int64)
        return pa.table({"list": [key[0].as_py()], "x": [x.tobytes()], "turned": [turned.tobytes()], "sizes": [sizes.tobytes()], "ids": [flat.tobytes()]}, schema=pa.schema([("list", pa.int32()), ("x", pa.binary()), ("turned", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())]))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        x = matrix(t.column("embedding"), lists.dim)
        return pa.table({"list": [key[0].as_py()], "q": [x.tobytes()], "bounds": [np.asarray(t.column("bound"), np.float64).tobytes()], "vs": [t.column("v").to_pylist()]}, schema=pa.schema([("list", pa.int32()), ("q", pa.binary()), ("bounds", pa.binary()), ("vs", pa.list_(pa.string()))]))

    def cut(df: DataFrame, size: int) -> DataFrame:
        """df with a column part: as many parts of a list as have about size rows each."""
        counts = {r["list"]: r["count"] for r in df.groupBy("list").count().collect()}  # a row a list
        parts = F.array(*(F.lit(-(-counts.get(i, 1) // size)) for i in range(len(lists.centres))))
        return df.withColumn("part", F.pmod(F.xxhash64("v"), F.element_at(parts, F.col("list") + 1)))

    chunks = cut(held, CHUNK).groupBy("list", "part").applyInArrow(chunk, "list int, x binary, turned binary, sizes binary, ids binary")
    packs = cut(asked, PACK).groupBy("list", "part").applyInArrow(pack, "list int, q binary, bounds binary, vs array<string>")
    return chunks, packs


def adaptive(turned: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """turned: columns of a chunk; q: rotated queries. The pairs (query, vector) that no test abandons."""
    depth = len(turned)
    who = what = None
    for a in range(0, depth, COLUMNS):
        b = min(depth, a + COLUMNS)
        if who is None:
            part = (q[:, a:b] ** 2).sum(1)[:, None] + (turned[a:b] ** 2).sum(0)[None, :] - 2 * q[:, a:b] @ turned[a:b]
            limit = bound[:, None]
        else:
            for c in range(a, b):
                part += (q[who, c] - turned[c, what]) ** 2
            limit = bound[who]
        slack = 1.0001 if b == depth else (1 + EPSILON / np.sqrt(b)) ** 2
        keep = part <= limit * (b / depth) * slack + 1e-6
        if who is None:
            who, what = np.nonzero(keep)
            part = part[who, what]
        else:
            who, what, part = who[keep], what[keep], part[keep]
    return who, what


def searched(chunks: DataFrame, packs: DataFrame, lists: Lists) -> DataFrame:
    """Per query vector and chunk its best candidates: v, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, turned, sizes, ids, q, bounds, vs = (batch.column(i)[row] for i in range(7))
                x = np.frombuffer(x.as_py(), lists.kind).reshape(-1, lists.dim).astype(np.float64)
                q = np.frombuffer(q.as_py(), lists.kind).reshape(-1, lists.dim)
                sizes, ids = np.frombuffer(sizes.as_py(), np.int32), np.frombuffer(ids.as_py(), np.int64)
                turned = np.frombuffer(turned.as_py(), np.float32).reshape(lists.dim + 1, -1)
                who, what = adaptive(turned, lists.turned(q, True), np.frombuffer(bounds.as_py(), np.float64))
                score = np.einsum("ij,ij->i", q[who].astype(np.float64), x[what])
                order = np.lexsort((-score, who))
                who, what, score = who[order], what[order], score[order]
                begin = np.searchsorted(who, who)
                near = np.arange(len(who)) - begin <= TOP  # of distinct vectors; ties beyond are looked at again
                edge = np.minimum(begin + TOP, len(who) - 1)
                near |= (who[edge] == who) & (score == score[edge])
                who, what, score = who[near], what[near], score[near]
                ends = np.cumsum(sizes)
                n = sizes[what]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[what] - n, n)
                names = vs.values.take(pa.array(np.repeat(who, n)))
                yield pa.RecordBatch.from_arrays([names, pa.array(ids[place]), pa.array(np.repeat(score, n))], names=["v", "vec_id", "score"])

    return chunks.join(packs, "list").select("x", "turned", "sizes", "ids", "q", "bounds", "vs").mapInArrow(run, "v string, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """Per query (vec_id divisible by every) and neighbour: query_id, rank, vec_id, score."""
    nodes = checkpointed(distinct(vectors, every))
    lists = fitted(nodes)
    if lists is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = nodes.where("asked")
    best = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")

    def best_of(queries: DataFrame, exact: bool) -> DataFrame:
        found = searched(*dealt(nodes, queries, lists, exact), lists).withColumn("place", F.row_number().over(best)).where(F.col("place") <= TOP + 1)
        return found.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))

    answers = checkpointed(best_of(asked, False))
    short = asked.join(answers.where(F.size("near") > TOP), "v", "left_anti")
    if not short.isEmpty():  # too few left in the probed lists: these look at all vectors
        short = checkpointed(short)
        answers = answers.join(short, "v", "left_anti").union(best_of(short, True))
    kept = vectors.where(usable(F.col("embedding")) & (F.col("vec_id") % every == 0)).select(F.col("vec_id").cast("long").alias("query_id"), typed(F.col("embedding"), vectors.schema["embedding"].dataType).alias("embedding"))
    by_id = kept.select("query_id", named_by(F.col("embedding")).alias("v")).distinct()
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, TOP)
    return by_id.join(answers, "v").select("query_id", F.posexplode(own).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
