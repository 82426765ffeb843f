import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorecraft.llm import queries
from tests.llm.conftest import SCHEMA, prose

FOLDER = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not there")


@there
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] == spark.read.parquet(f"{FOLDER}/documents.parquet").where(F.col("text").rlike(r"\p{L}")).count()  # only texts without a letter go
    assert 0.7 * counts[1] < counts[2] < counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(docs)


def test_stages_of_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_rejects(spark, rng, tmp_path):
    rows = [(i, prose(rng, 40), "en", "s", 1) for i in range(30)] + [(100, None, "en", "s", 1), (101, "1234 ###", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.languages(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(30))


@there
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_its_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, FOLDER).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_columns_that_clash_stay(spark, rng, tmp_path):
    rows = [(i, prose(rng, 40), "en", f"s{i % 2}", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("score", "predicted", "lang_pred", "size", "class_id", "kept", "copies", "ids"):
        docs = docs.withColumn(c, F.lit("clash"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.where("score <> 'clash' OR kept <> 'clash' OR size <> 'clash'").isEmpty(), name
        docs = docs.checkpoint()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() > 0


@there
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    if name in ("mix_targets", "shard_law"):
        return  # a row a source or shard
    table = {"op1_vector_dups": "embeddings", "op4_media": "embeddings", "op12_repair": "conversations", "op13_clusters": "embeddings"}.get(name, "documents")
    key = {"embeddings": "vec_id", "conversations": "conv_id"}.get(table, "doc_id")
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    rows = rows.select(key).distinct() if table == "conversations" else rows
    assert got.count() == rows.count() and got.select(key).exceptAll(rows.select(key)).isEmpty()
    scores = [c for c in got.columns if c == "score"]
    assert all(got.where((F.col(c) < 0) | (F.col(c) > 1) | F.col(c).isNull()).isEmpty() for c in scores)


def test_stages_of_odd_rows(spark, docs, documents, tmp_path):
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda name: sorted(map(repr, map(tuple, stage[name](spark, docs, str(tmp_path)).collect())))
    given = sorted(map(repr, documents))
    letters = sorted(repr(r) for r in documents if r[1] and any(c.isalpha() for c in r[1]))
    assert rows("language") == letters
    good = rows("quality")
    assert all(good.count(r) <= given.count(r) for r in good)
    texts = {}
    for r in documents:
        texts.setdefault(r[1], set()).add(repr(r) in good)
    assert all(len(kept) == 1 for kept in texts.values())  # equal texts go or stay together
    kept = stage["near_duplicates"](spark, docs, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and not set(ids) & set(range(201, 205)) and 107 in ids and 200 not in ids
    assert {r[0] for r in documents[:13]} <= set(ids) and sum(r["doc_id"] is None for r in kept) == 1
    mixed = rows("mixing")
    assert set(mixed) <= set(given) and all(mixed.count(r) <= 3 * given.count(r) for r in mixed)
    coded = stage["pieces"](spark, docs, str(tmp_path))
    assert coded.count() == len(documents) and coded.where("doc_id IN (0, 1) AND n_tokens = 0").count() == 2
