"""The pipeline's stages against brute force, and the registered corpus queries against their SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.test_search_and_groups import least_reachable, plain_fingerprint
from tests.llm.test_text_operators import plain_removal
from tidemark.llm import queries
from tidemark.session import materialise
from tools.check import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, folder, name):
    base = duckdb.connect()
    for t in TABLES.split():
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = contract.queries()[name](spark, folder)
    relation = base.execute(contract.oracle_sql()[name])
    want = rows_of([d[0] for d in relation.description], relation.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_operator_has_one_query():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in contract.queries() if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in contract.queries()


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r["doc_id"] for r in contract.queries()["op5_toxicity"](spark, folder).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.collect()
        docs = materialise(stage(spark, docs, folder))
        after = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r["doc_id"] for r in before}
        kept = {r["doc_id"] for r in after}
        if name == "toxicity":
            assert kept == ids - toxic
        elif name == "simhash_near_dedup":
            prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in before}
            links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
            assert kept == set(least_reachable(prints, links).values())
        elif name == "substring_dedup":
            removed = {r[0]: r[2] for r in plain_removal([(r["doc_id"], r["text"]) for r in before], 50)}
            text = {r["doc_id"]: r["text"] for r in before}
            assert kept == ids
            for r in after:
                assert r["n_chars"] == len(r["text"])
                if removed[r["doc_id"]]:
                    assert len(r["text"].split()) == len(text[r["doc_id"]].split()) - removed[r["doc_id"]]
                else:
                    assert r["text"] == text[r["doc_id"]]
        else:
            assert kept < ids and len(kept) > len(ids) / 5
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_a_rare_source_does_not_shrink_the_mixture(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rare = docs.limit(1).selectExpr("-5L doc_id", "'twenty words ' || repeat('w ', 18) text", "lang", "'stray' source", "n_chars")
    docs.union(rare.select(*docs.columns)).write.parquet(str(tmp_path / "documents.parquet"))
    got = contract.queries()["op9_source_mixture"](spark, str(tmp_path)).collect()
    total = sum(r["tokens"] for r in got)
    assert sum(r["tokens"] * r["probability"] for r in got) == pytest.approx(0.75 * total, rel=1e-3)
    kept = corpus_pipeline.mixed(spark, docs.union(rare.select(*docs.columns)), folder).count()
    assert kept > 0.6 * len(got)


def test_pipeline_of_odd_documents(spark, make_docs, odd_texts, folder):
    docs = make_docs(odd_texts)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder))
    assert docs.count() > 2
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder))
    assert docs.collect() == []
