r"""Operator 1: secret scans that link the parts of multipart credentials. DataFrame functions only.

Three kinds are reported wherever they stand: assign, access and hex (BASE). Three more
are too weak alone: an account name (ident), a bare or badly labelled key (weak), an
address (endpoint). Parts of one text whose spans are REACH code points apart or less
share a scope. An interval join finds them: each span, widened by REACH, is dealt to the
bins of REACH code points that it touches, and spans of complementary kinds are joined on
text and bin and then held against each other. A bin holds no more spans than fit into
REACH code points, so the join grows with the text only, however many parts one text has.

A weak part is reported when its complement is in scope: an identifier or an endpoint
when there is a secret, a weak secret when there is an identifier or an endpoint. Parts
of the base kinds complete others: access is an identifier, assign and hex are secrets.
A weak part that overlaps a base span, or of the weak kinds an earlier one as listed,
isn't counted anew.

Positions are code points, found without Python: splitting a text at a pattern and
extracting the pattern give by turns what lies between matches and the matches; sums of
their lengths are the positions.

Every text is searched once, and what is found written to the checkpoint folder; texts
without any part need no join and stay where they are, only the others are joined. Very
long texts are searched whole; a text's spans are one array. Null text counts as empty. Repeated rows, and rows that share a doc_id, each get their own
result; doc_id may be null. An empty table gives an empty result. Further columns are
ignored by scan() and kept by redacted().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import checkpointed, named, table, with_row_id

REACH = 200
#: By kind, in the order of report: the pattern, and the least length of its group 2, if it has one, or else of the match.
BASE = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
}
LINKED = {
    "ident": (r"(?i)(user_?name|user|login|account|client_?id|access_?key_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]+)", 3),
    "weak": (r"(?i)(pass|pwd|pw|key|auth|credential|bearer)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8),
    "endpoint": (r"(?i)([a-z][a-z0-9+]*://|host(?:name)?[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9._:/@-]+)", 4),
}
KINDS = [*BASE, *LINKED]
#: What completes a part of each weak kind.
COMPLEMENT = {"ident": ["assign", "hex", "weak"], "weak": ["access", "ident", "endpoint"], "endpoint": ["assign", "hex", "weak"]}
#: Lengths are summed in blocks of this many, so that no array is copied more than this often.
BLOCK = 128
ROW = "row of the table"
SPAN = "struct<kind:int,begin:int,end:int>"


def ends(lengths: Column) -> Column:
    """Running sums of lengths, first within blocks, then over blocks."""
    zero = F.array().cast("array<int>")

    def run(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

    count = F.ceil(F.size(lengths) / BLOCK).cast("int")
    blocks = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), count)), lambda i: i <= count), lambda i: run(F.slice(lengths, (i - 1) * BLOCK + 1, F.lit(BLOCK))))

    def shifted(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.element_at(b, -1))
        return named(run(totals), lambda sums: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.element_at(sums, i + 1) - F.element_at(b, -1)))))

    return named(blocks, shifted)


def spans(text: Column, kind: str) -> Column:
    """The matches of one kind as an array of structs kind (a number), begin, end."""
    pattern, least = (BASE | LINKED)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if "(" in pattern.removeprefix("(?i)") else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    stops = named(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda z: F.array(F.length(z["g"]), F.length(z["m"])))), ends)

    def placed(stops: Column) -> Column:
        return F.transform(
            F.arrays_zip(found.alias("m"), sized.alias("v")),
            lambda z, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (F.element_at(stops, 2 * i + 2) - F.length(z["m"])).alias("begin"), F.element_at(stops, 2 * i + 2).alias("end"), F.length(z["v"]).alias("n")),
        )

    kept = F.transform(F.filter(named(stops, placed), lambda s: s["n"] >= least), lambda s: F.struct(s["kind"], s["begin"], s["end"]))
    return F.when(F.regexp_like(text, F.lit(pattern)), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def parted(docs: DataFrame) -> DataFrame:
    """docs with the arrays base and parts: the spans of the base kinds, and those of the weak kinds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("base", F.concat(*(spans(text, k) for k in BASE))).withColumn("parts", F.concat(*(spans(text, k) for k in LINKED)))


def links(parts: DataFrame) -> DataFrame:
    """parts: ROW, base, parts. Returns each reported weak span: ROW, kind, begin, end."""
    every = parts.select(ROW, F.explode(F.concat("base", "parts")).alias("s")).select(ROW, "s.*")
    weak_kinds = [KINDS.index(k) for k in LINKED]
    touched = F.explode(F.sequence((F.greatest(F.lit(0), F.col("begin") - REACH) / REACH).cast("int"), ((F.col("end") + REACH) / REACH).cast("int"))).alias("bin")
    left = every.where(F.col("kind").isin(weak_kinds)).select(ROW, "kind", "begin", "end", touched)
    over = F.explode(F.sequence((F.col("begin") / REACH).cast("int"), (F.col("end") / REACH).cast("int"))).alias("bin")
    right = every.select(ROW, F.col("kind").alias("k"), F.col("begin").alias("b"), F.col("end").alias("e"), over)
    near = (F.col("b") <= F.col("end") + REACH) & (F.col("e") >= F.col("begin") - REACH)
    overlap = (F.col("b") < F.col("end")) & (F.col("e") > F.col("begin")) & (F.col("k") < F.col("kind"))
    completes = F.lit(False)
    for kind, others in COMPLEMENT.items():
        completes = completes | ((F.col("kind") == KINDS.index(kind)) & F.col("k").isin([KINDS.index(o) for o in others]))
    apart = (F.col("b") >= F.col("end")) | (F.col("e") <= F.col("begin"))
    joined = left.join(right, [ROW, "bin"]).where(near & ((completes & apart) | overlap))
    held = joined.groupBy(ROW, "kind", "begin", "end").agg(F.max(overlap).alias("covered"), F.max(completes & apart).alias("completed"))
    return held.where("completed and not covered").select(ROW, "kind", "begin", "end")


def scanned(parts: DataFrame) -> DataFrame:
    """parts: ROW, base, parts and other columns, each row computed once. Instead of parts: spans (all reported, in order); base is put in order."""
    extra = links(parts.select(ROW, "base", "parts")).groupBy(ROW).agg(F.collect_list(F.struct("kind", "begin", "end")).alias("extra"))
    by_place = lambda s: F.array_sort(F.transform(s, lambda x: F.struct(x["begin"], x["kind"], x["end"])))
    merged = F.concat("base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>")))
    weak = F.size("parts") > 0
    joined = parts.where(weak).join(extra, ROW, "left")
    alone = parts.where(~weak).withColumn("extra", F.lit(None).cast(f"array<{SPAN}>"))  # nothing to link
    return joined.unionByName(alone).withColumn("spans", by_place(merged)).withColumn("base", by_place(F.col("base"))).drop("parts", "extra")


def written(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    both = scanned(checkpointed(parted(with_row_id(docs.select("doc_id", "text"), ROW)).drop("text")))
    of_kind = lambda i: F.filter("base", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return both.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span but endpoints, overlapping ones as one, replaced by mark in text."""
    kept = [F.col(f"`{c}`").alias(f"column {i}") for i, c in enumerate(docs.columns) if c != "text"]
    rows = with_row_id(docs.select("text", *kept), ROW)
    found = scanned(checkpointed(parted(rows))).withColumn("spans", F.filter("spans", lambda s: s["kind"] != KINDS.index("endpoint")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["begin"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, s["begin"] - acc["at"])
        return F.struct(F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = F.when(F.size("spans") > 0, done).otherwise(F.col("text"))
    return found.select(*(changed.alias(c) if c == "text" else F.col(f"column {i}").alias(c) for i, c in enumerate(docs.columns)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets taken out of text; n_chars, where there is such a column, is counted anew."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
