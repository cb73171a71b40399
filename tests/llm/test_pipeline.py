import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from talus.llm import mixing
from tests.llm import test_near_copies as near

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER).cache()
        assert after.columns == docs.columns
        steps[name] = (docs, after)
        docs = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = steps["toxicity"]
    clean = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean & ids(before) - ids(after)) <= 0.05 * len(clean)
    before, after = steps["language"]
    assert {r.doc_id for r in before.where(~F.col("text").rlike(r"\p{L}") | F.col("text").isNull()).collect()} <= ids(before) - ids(after)
    assert len(ids(before) - ids(after)) <= 0.01 * before.count()
    before, after = steps["near_dedup"]
    assert sorted(r.doc_id for r in after.collect()) == near.kept([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
    before, after = steps["mixing"]
    drawn = {r.doc_id: len(r.shards) for r in mixing.digest(before).collect()}
    times = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert times == {d: n for d, n in drawn.items() if n}


def test_run(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids)


def test_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in queries()) == 1 for n in names) and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())
