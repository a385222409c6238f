r"""Operator 6: WARC files, and a fixity audit of replicas by Merkle trees.

records() makes WARC/1.1 response records of pages, members() compresses each as the gzip
member that it is in a .warc.gz file, read() reads files of either kind. A
record's offset is where it begins in the concatenation of all records in order, so the
table of records says what byte ranges a replica must hold.

leaves() puts a replica's records in order and cuts the order into ranges, each replica on
its own: a record whose hash ends in L hexadecimal zeros begins a range of level L, and of
all lower ones, so ranges hold some 16 of the level below wherever they stand, and a lost
or additional record doesn't shift those after it. A range is named by the record that
begins it. tree() hashes records (SHA-256, with size and copies: the leaves) and, level by
level, the ranges' parts in order, up to one root. audit() compares the roots of two trees
and, where they differ, goes down: only parts of differing ranges are joined at the next
level, by name, so what a level reads grows with the damage and not with the archive. In
differing ranges of level 1 it tells corrupt records (another of the same key stands there)
from missing and additional ones.

Records are ordered by key, then digest; equal records (repeated rows) are one leaf with a
count, as no order tells them apart; so a range's size follows from hashes, not from how
many records have one key. Null key, url and html are allowed (a null html has an empty
payload). A very long html is a record like any other, hashed in the JVM. Two empty archives
agree; an empty one differs from any other in all of its records. Additional columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import checkpointed, table

#: Levels of ranges that records may begin: 16^LEVELS records are some 10^12.
LEVELS = 10
DATE = "2024-01-01T00:00:00Z"
#: Which keys damaged() cuts, changes and drops.
CUT, TURNED, LOST = ["07", "17"], ["13", "23"], ["29", "39"]


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Per distinct page: key, record (the bytes of a WARC record), payload_sha256, copies."""
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "utf-8")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    digest = F.sha2(payload, 256)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:key:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), digest, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(payload)).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(F.encode(head, "utf-8"), F.encode(http, "utf-8"), payload, F.encode(F.lit("\r\n\r\n"), "utf-8"))
    return pages.select(F.col(key).alias("key"), record.alias("record"), digest.alias("payload_sha256"))


def leaves(found: DataFrame) -> DataFrame:
    """found: key, record. Per distinct record in order: place (from 0), key, hash, size, copies, begin, end (offsets), ranges (names of those it's in, from level 1 up)."""
    slim = found.select("key", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("size"))
    return placed(slim.groupBy("key", "hash", "size").agg(F.count(F.lit(1)).alias("copies")))


def placed(each: DataFrame) -> DataFrame:
    """Places, offsets and ranges by parts: each part's rows are numbered on their own, and what parts before bring (one row each) is added."""
    order = [F.col("key").asc_nulls_first(), F.col("hash")]
    parts = checkpointed(each.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    rows = Window.partitionBy("part").orderBy(*order)
    within, so_far = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bytes_of = F.col("size") * F.col("copies")
    level = F.length("hash") - F.length(F.rtrim("hash", F.lit("0")))
    begun = [F.when(level >= i, F.xxhash64("key", "hash")) for i in range(1, LEVELS + 1)]
    numbered = parts.select("*", F.count(F.lit(1)).over(within).alias("i"), F.coalesce(F.sum(bytes_of).over(within), zero).alias("o"), *(F.last(b, True).over(so_far).alias(f"r{i}") for i, b in enumerate(begun)))
    last = [F.max_by(b, F.when(b.isNotNull(), F.struct(F.col("key").isNotNull(), F.col("key"), F.col("hash")))) for b in begun]
    sums = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_of).alias("b"), *(x.alias(f"l{i}") for i, x in enumerate(last)))
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("b").over(before), zero).alias("b0"), *(F.last(f"l{i}", True).over(before).alias(f"l{i}") for i in range(LEVELS)))
    begin = F.col("b0") + F.col("o")
    ranges = F.array(*(F.coalesce(f"r{i}", f"l{i}", zero) for i in range(LEVELS)))
    return numbered.join(F.broadcast(starts), "part").select((F.col("n0") + F.col("i")).alias("place"), "key", "hash", "size", "copies", begin.alias("begin"), (begin + bytes_of).alias("end"), ranges.alias("ranges"))  # starts: one row a partition


def tree(leaf: DataFrame, height: int) -> list[DataFrame]:
    """From the leaves, over height levels of ranges, to the root, each with up (the names of the ranges it's in), name (for leaves: none), hash."""
    level = leaf.select(F.slice("ranges", 1, height).alias("up"), "place", F.sha2(F.concat_ws(":", F.lit("leaf"), "hash", "size", "copies"), 256).alias("hash"))
    out = [level]
    for _ in range(height + 1):
        children = F.array_sort(F.collect_list(F.struct("place", "hash")))  # some 16
        level = level.groupBy("up").agg(F.min("place").alias("place"), F.sha2(F.concat_ws(",", F.transform(children, lambda c: c["hash"])), 256).alias("hash"))
        level = checkpointed(level.select(F.try_element_at("up", F.lit(1)).alias("name"), F.slice("up", 2, LEVELS).alias("up"), "place", "hash"))
        out.append(level)
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """primary, replica: leaves(). The records that differ: place (in the primary), key, status (corrupt, missing, additional), begin, end (where the record is, or for additional ones where it is in the replica), expected, found."""
    sides = [checkpointed(primary), checkpointed(replica)]
    count = max(x.count() for x in sides)
    height = next(h for h in range(LEVELS + 1) if count <= 16**h or h == LEVELS)
    ours, theirs = (tree(x, height) for x in sides)
    suspects: DataFrame | None = None  # differing ranges: name and up in one array
    for a, b in zip(reversed(ours[1:]), reversed(theirs[1:]), strict=True):
        named = [x.select(F.when(F.col("name").isNull(), F.array().cast("array<long>")).otherwise(F.concat(F.array("name"), "up")).alias("path"), "up", "hash") for x in (a, b)]
        if suspects is not None:
            up = suspects.select(F.col("path").alias("up"))
            named = [x.join(up, "up", "left_semi") for x in named]
        other = named[1].select("path", F.col("hash").alias("other"))
        suspects = checkpointed(named[0].join(other, "path", "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("path"))
        if suspects.isEmpty():
            break
    records = [x.withColumn("path", F.slice("ranges", 1, height)).join(suspects, "path", "left_semi").withColumn("k", F.coalesce(F.col("key").cast("string"), F.lit("\0"))) for x in sides]
    same = ["k", "hash", "copies"]
    rank = F.row_number().over(Window.partitionBy("k").orderBy("hash")).alias("rank")
    lost, more = (x.join(y.select(*same), same, "left_anti").select("*", rank) for x, y in (records, records[::-1]))
    more = more.select("k", "rank", F.col("key").alias("other key"), F.col("hash").alias("found"), F.col("begin").alias("b"), F.col("end").alias("e"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("hash").isNull(), "additional").otherwise("corrupt")
    return lost.join(more, ["k", "rank"], "full").select("place", F.coalesce("key", "other key").alias("key"), status.alias("status"), F.coalesce("begin", "b").alias("begin"), F.coalesce("end", "e").alias("end"), F.col("hash").alias("expected"), "found")


def damaged(found: DataFrame) -> DataFrame:
    """A replica with known damage for the query: by two digits of the md5 of the key some records lose their last byte, some have one byte changed, some are gone."""
    draw = F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))), 1, 2)
    n = F.octet_length("record")
    # \r\n\r\n at the end of each record: a changed byte is one of these
    changed = F.concat(F.substring("record", 1, n - 1), F.encode(F.lit("\0"), "utf-8"))
    record = F.when(draw.isin(CUT), F.substring("record", 1, n - 1)).when(draw.isin(TURNED), changed).otherwise(F.col("record"))
    return found.where(~draw.isin(LOST)).withColumn("record", record)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its range, hash and what the audit of a damaged replica says of it (intact where it agrees)."""
    found = records(table(spark, sf_dir, "pages"))
    primary = checkpointed(leaves(found))
    wrong = audit(primary, leaves(damaged(found))).where("place is not null").select("place", "status", F.col("found").alias("replica_sha256"))
    whole = primary.join(wrong, "place", "left")
    return whole.select(F.col("key").alias("page_id"), "place", F.col("begin").alias("begin_offset"), F.col("end").alias("end_offset"), "copies", F.col("hash").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"), "replica_sha256")


SQL = r"""
WITH parts AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, coalesce(url, '') AS url FROM pages
), http AS (
  SELECT *, encode('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) ||
                   'Content-Length: ' || octet_length(payload) || chr(13) || chr(10) || chr(13) || chr(10)) AS http FROM parts
), whole AS (
  SELECT page_id, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:key:' ||
         coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) ||
         'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(payload) || chr(13) || chr(10) ||
         'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' ||
         (octet_length(http) + octet_length(payload)) || chr(13) || chr(10) || chr(13) || chr(10)) || http || payload AS head
  FROM http
), hashed AS (
  SELECT page_id, sha256(head || encode(chr(13) || chr(10) || chr(13) || chr(10))) AS hash,
         sha256(head || encode(chr(13) || chr(10) || chr(13))) AS cut,
         sha256(head || encode(chr(13) || chr(10) || chr(13)) || '\x00'::BLOB) AS turned,
         (octet_length(head) + 4)::BIGINT AS size, count(*)::BIGINT AS copies
  FROM whole GROUP BY ALL
)
SELECT page_id, (row_number() OVER o - 1)::BIGINT AS place,
       (sum(size * copies) OVER o - size * copies)::BIGINT AS begin_offset, (sum(size * copies) OVER o)::BIGINT AS end_offset,
       copies, hash AS record_sha256,
       CASE WHEN draw IN ('29', '39') THEN 'missing' WHEN draw IN ('07', '17', '13', '23') THEN 'corrupt' ELSE 'intact' END AS status,
       CASE WHEN draw IN ('07', '17') THEN cut WHEN draw IN ('13', '23') THEN turned END AS replica_sha256
FROM (SELECT *, substr(md5(coalesce(page_id::VARCHAR, '')), 1, 2) AS draw FROM hashed)
WINDOW o AS (ORDER BY page_id NULLS FIRST, hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def members(found: DataFrame) -> DataFrame:
    """found: key, record. Each record as a gzip member, so that members put one after the other are a .warc.gz file: key, member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gzip.compress(r.as_py(), mtime=0) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "member"])

    return found.select("key", "record").mapInArrow(run, f"key {found.schema['key'].dataType.simpleString()}, member binary")


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file, plain or gzip by members: headers (names in lower case) and block."""
    if content[:2] == b"\x1f\x8b":
        plain = []
        while content:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(content) + member.flush())
            content = member.unused_data
        content = b"".join(plain)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError(f"the record at {at} has no end of headers")
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers.get("content-length", "0"))
        block = content[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at {at} is cut off")
        yield headers, block
        at = stop + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files at path: file, type, uri, headers, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for h, block in parsed(content.as_py()):
                    row = [name.as_py(), h.get("warc-type"), h.get("warc-target-uri"), list(h.items()), block]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["file", "type", "uri", "headers", "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, type string, uri string, headers map<string,string>, block binary")
