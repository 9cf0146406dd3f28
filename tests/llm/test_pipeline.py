"""Stages of the corpus pipeline against plain versions of their decisions, and registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, compare
from quadlab.llm import quality_rules, queries
from tests.llm.test_dedup import brute_components, word_sets
from tests.llm.test_scans import plain_overlap

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = {r.doc_id for r in quality_rules.judged(docs).collect() if r.kept}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = {r.doc_id: r for r in out.collect()}
        before = texts or {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert set(rows) == kept
        elif name == "line_dedup":
            sites, first = {}, {}
            for r in sorted(docs.collect()):
                for k, x in enumerate(r.text.split("\n")):
                    if x.strip():
                        sites.setdefault(x.strip(), set()).add(r.source)
                        first.setdefault(x.strip(), (r.doc_id, k))
            spread = {x for x, s in sites.items() if len(s) >= 6}
            want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if x.strip() not in spread or first[x.strip()] == (i, k)) for i, t in before.items()}
            assert {i: r.text for i, r in rows.items()} == {i: t for i, t in want.items() if t.strip()}
            assert all(r.n_chars == len(r.text) for i, r in rows.items() if r.text != before[i])
        elif name == "near_dedup":
            assert set(rows) == set(brute_components({i: word_sets(t, 5) for i, t in before.items()}, 80).values())
        else:
            assert set(rows) == {i for i, t in before.items() if all(plain_overlap(t, x) is None for x in items)}
        texts = {i: r.text for i, r in rows.items()}
        docs = spark.createDataFrame(list(rows.values()), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert {(r.doc_id, r.piece) for r in packed} == {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()}


@pytest.mark.parametrize("name", [*queries.QUERIES])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    text, ok = compare(spark, con, name, SF)
    assert ok, text


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
