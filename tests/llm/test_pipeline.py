"""The pipeline's stages, each on what its predecessor kept, against plain Python; operators with SQL against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tessel.llm import decontamination, queries, quality, secrets

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = duck.execute(queries.SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(str(tuple(r)) for r in found.select(*columns).collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    name, stage = corpus_pipeline.STAGES[0]
    assert name == "quality_classifier"
    kept = stage(spark, docs, DATA)
    assert kept.columns == columns
    scores = {r["doc_id"]: r["predicted"] for r in quality.op4(spark, DATA).collect()}
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert left == {d: t for d, t in rows.items() if scores[d]}

    docs = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(kept.collect(), kept.schema), DATA)
    assert docs.columns == columns
    sets = {d: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").encode().lower().split()) for d, t in left.items()}
    top = {d: d for d in left}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in left:
        for b in left:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                top[max(root(a), root(b))] = min(root(a), root(b))
    left = {d: t for d, t in left.items() if root(d) == d}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == left

    docs = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(docs.collect(), docs.schema), DATA)
    bench = [t for (t,) in duckdb.sql(f"select text from '{DATA}/benchmark.parquet'").fetchall()]
    token = lambda t: " ".join(decontamination.TOKEN.findall(t.lower()))
    clean = {d: t for d, t in left.items() if not any(token(b) in token(t) for b in bench)}
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == clean

    docs = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(docs.collect(), docs.schema), DATA)
    out = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns and set(out) == set(clean)
    assert {d: r["text"] for d, r in out.items() if "[secret]" not in r["text"]} == {d: t for d, t in clean.items() if "[secret]" not in out[d]["text"]}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert not any(s["spans"] for s in secrets.scan(docs).collect())


def test_run(spark):
    found = corpus_pipeline.run(spark, DATA).collect()
    assert found and {"doc_id", "taken", "target"} <= set(found[0].asDict())
    for source in {r["source"] for r in found}:
        mine = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
