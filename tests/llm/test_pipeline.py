"""The pipeline's stages against plain versions, and the registered queries on the smallest test data."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talktree.llm import registry
from talktree.llm.near_dedup import NearDupParams, near_duplicates
from talktree.llm.quality import quality_rules, train_quality
from tests.llm.test_near_dedup import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_stages_follow_each_other(spark):
    docs = read(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    schema, kept = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name != names[-1]:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema]
        kept[name] = out
        docs = out
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in kept.items()}

    source = read(spark, "documents")
    model = train_quality(source, read(spark, "labels"))
    assert ids["quality_rules"] == sorted(r.doc_id for r in quality_rules(source, model).where("kept").collect())
    rows = [(r.doc_id, r.text) for r in kept["quality_rules"].collect()]
    assert ids["near_dedup"] == sorted(i for i, (_, c) in brute(rows, 5).items() if i == c)
    assert ids["secret_scan"] == ids["decontamination"] and set(ids["decontamination"]) <= set(ids["near_dedup"])
    items = [" ".join(r.text.lower().split()) for r in read(spark, "benchmark").collect()]
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in kept["near_dedup"].collect()}
    for i, t in texts.items():
        if any(x in t for x in items):
            assert i not in ids["decontamination"]
    before = {r.doc_id: r.text for r in kept["decontamination"].collect()}
    for r in kept["secret_scan"].collect():
        assert r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) != ("[SECRET]" in r.text)
    assert set(ids["best_fit_packing"]) == set(ids["secret_scan"])
    assert corpus_pipeline.run(spark, DATA).count() == len(ids["best_fit_packing"])


def test_odd_documents_pass_through(spark):
    good = read(spark, "documents").where("doc_id = 0").first().text
    rows = [(1, good, "en", "s", len(good), "a", "b"), (None, good + " more words at the end", "en", None, 5, "a", "b"), (2, None, None, None, None, None, None), (3, "", None, None, 0, None, None), (4, "token=abcdefgh1 " + good, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, base_spans string, kept string")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.where("false")):
            out = stage(spark, df, DATA)
            assert out.count() >= 0
            if name != "best_fit_packing":
                assert out.columns == docs.columns
    blotted = dict(corpus_pipeline.secrets(spark, docs, DATA).select("doc_id", "text").where("doc_id in (2, 4)").collect())
    assert blotted[2] is None and blotted[4].startswith("[SECRET] ")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.sql(registry.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(repr, result.select(*columns).fetchall()))


def test_registered_queries(spark):
    assert [q.split("_")[0] for q in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
    for name in ("op1_quality_rules", "op2_secret_scan", "op6_language_id"):
        out = registry.QUERIES[name](spark, DATA)
        assert out.count() == read(spark, "documents").count() == out.select(F.countDistinct("doc_id")).first()[0]


def test_near_duplicates_of_the_test_data(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(read(spark, "documents"), params=NearDupParams(shingle=4)).collect()}
    assert got == brute(rows, 4)


def test_columns_that_clash_with_own_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "a b c", "x", "y")], "doc_id long, text string, _gone string, item_words string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()] == [1]
    assert corpus_pipeline.decontamination(spark, docs, DATA).columns == docs.columns
