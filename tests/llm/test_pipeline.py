"""The pipeline against plain versions of its stages, and the registered queries."""

import plain
import pytest
from compare import compare, database
from pyspark.sql import functions as F

import corpus_pipeline
from shelfgrain.llm import mixing, packing, queries, toxicity


def order(rows):
    return sorted(rows, key=repr)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near duplicates", "mixing", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i for i, r in rows.items() if plain.kept(r.text)}
    good = corpus_pipeline.quality_rules(spark, docs, folder)
    assert order(good.collect()) == order(rows[i] for i in kept) and good.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(good, labels).collect()}
    clean = corpus_pipeline.toxicity(spark, good, folder)
    kept = {i for i in kept if not scores[i]}
    assert order(clean.collect()) == order(rows[i] for i in kept)
    groups = plain.near_copies([(i, rows[i].text) for i in kept])
    kept = {i for i in kept if groups[i] == i}
    single = corpus_pipeline.near_duplicates(spark, clean, folder)
    assert order(single.collect()) == order(rows[i] for i in kept)
    mixed = corpus_pipeline.mixing(spark, single, folder)
    taken = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix_documents(single).collect()}
    copies = [i for i in kept for _ in range(taken[i])]
    assert order(mixed.collect()) == order(rows[i] for i in copies) and mixed.columns == docs.columns
    packed = corpus_pipeline.packing(spark, mixed, folder).groupBy("doc_id").agg(F.sum("length")).collect()
    alone = {r.doc_id: r.n for r in packing.tokenize(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert order(tuple(r) for r in packed) == order((i, alone[i] * copies.count(i)) for i in set(copies))
    whole = corpus_pipeline.run(spark, folder)
    assert whole.agg(F.sum("length")).first()[0] == sum(alone[i] for i in copies)


def test_registered(spark):
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_no_documents(spark, tmp_path, folder):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, folder, name):
    problem, _, _ = compare(spark, database(folder), folder, name, queries.QUERIES[name], queries.ORACLE[name])
    assert problem is None, problem
