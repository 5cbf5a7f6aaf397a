import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kgloom.llm import jaccard, toxicity
from kgloom.llm.common import stored, table


def test_each_stage_works_on_what_the_one_before_kept(spark, sf):
    docs = table(spark, sf, "documents")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), name)
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids is None or now <= ids
        if name != "packing":
            assert out.columns == columns
            docs, ids = out, now
        if name == "near_duplicates":
            found = jaccard.near_duplicates(out, 5, 80)
            assert found.where("doc_id <> component_id").count() == 0
        if name == "secrets":
            assert out.count() == len(now)
    assert now == ids


def test_the_toxic_go(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    gone = {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - gone


def test_nulls_repeated_rows_and_extra_columns(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    text = docs.where("length(text) > 200").first()
    odd = docs.limit(4).withColumn("text", F.when(F.col("doc_id") % 2 == 0, "").otherwise(None)).withColumn("doc_id", F.col("doc_id") + 10_000)
    again = docs.where(F.col("doc_id") == text.doc_id).withColumn("doc_id", F.lit(20_000).cast("long"))
    mixed = stored(docs.union(odd).union(again).withColumn("n", F.lit("own")).withColumn("start", F.lit(1)).withColumn("component_id", F.lit(2)), "mixed")
    out = mixed
    for name, stage in corpus_pipeline.STAGES[1:]:  # the first needs the labels of its documents
        out = stored(stage(spark, out, sf), name)
        if name != "packing":
            assert out.columns == mixed.columns
    ids = {r.doc_id for r in out.collect()}
    assert {r.doc_id for r in odd.collect()} <= ids and len(ids & {text.doc_id, 20_000}) <= 1
    empty = mixed.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, sf).count() == 0


def test_pairs_made_at_once_are_bounded():
    lengths = np.array([jaccard.BLOCK, 3, 2] * 40 + [2 * jaccard.BLOCK, 2])
    ranges = list(jaccard.runs(lengths))
    assert [k for at, past in ranges for k in range(at, past)] == list(range(len(lengths)))
    assert all(past == at + 1 or (lengths[at:past] ** 2).sum() <= 1_000_000 for at, past in ranges)
