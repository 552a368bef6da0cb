"""The stages of the pipeline and the named queries."""

import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from payouts.llm import decontaminate, pieces, toxicity

from .conftest import CLASHES, ROWS
from .test_copies import brute_components, normal

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    numbers = [int(m[1]) for n in __spark_entry__.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_pipeline_against_brute_force(spark, sample):
    model = toxicity.train(sample, spark.read.parquet(f"{FOLDER}/labels.parquet"), ~toxicity.held_out("label_id", 4, 2))
    rows = [(r["doc_id"], r["text"]) for r in toxicity.scored(sample, model).filter(f"score < {toxicity.THRESHOLD}").collect()]
    firsts = {}
    for i, t in sorted(rows):
        firsts.setdefault(normal(t), (i, t))
    rows = sorted(firsts.values())
    smallest = {i: c for i, _, c in brute_components(rows)}
    rows = [(i, t) for i, t in rows if smallest[i] == i]
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dirty = {r["doc_id"] for r in decontaminate.contamination(docs, benchmark).filter("contaminated").collect()}
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == [*sample.columns, "ids"]
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {i: t for i, t in rows if i not in dirty}
    v = pieces.load(pieces.default_model())
    assert all(pieces.decode(np.array(r["ids"], np.int32), v) == r["text"] for r in found.limit(50).collect())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_at_the_edges(spark, edge_docs, no_docs, stage):
    name, function = stage
    for docs in (edge_docs, no_docs):
        out = function(spark, docs, FOLDER)
        assert out.columns[: len(docs.columns)] == docs.columns
        kept = out.count()
        assert kept <= (len(ROWS) if docs is edge_docs else 0)
        if name == "sentencepiece":
            assert kept == (len(ROWS) if docs is edge_docs else 0)
        else:
            assert out.columns == docs.columns and (kept >= 6 or docs is no_docs)
    assert len(CLASHES) > 10


@pytest.mark.parametrize("name", ["op3_ngram_jaccard_join", "op4_secret_scan", "op5_exact_dedup", "op9_decontamination"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, FOLDER)
    columns = ", ".join(sorted(found.columns))
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == sorted(con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())


def test_pipeline_keeps_the_last_stage_only(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "new_folder", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda _, docs, __: docs.limit(50)) for n in ("a", "b", "c")])
    assert corpus_pipeline.run(spark, FOLDER).count() == 50
    assert [p.name for p in tmp_path.iterdir()] == ["pipeline-c"]
