"""The stages one after the other on a small table, and each stage's decisions."""

import corpus_pipeline
from pyspark.sql import functions as F

from .cases import frame, texts, words

SF = "/root/testdata/sf0.001"


def test_columns_and_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        if k < 4:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            after = corpus_pipeline.materialise(after)
            assert after.where("n_chars <> length(text)").count() == 0
        counts.append(after.count() if k < 4 else after.select("doc_id").distinct().count())
        before = after
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] == counts[5]
    # most documents of the table are clean, and stay
    assert counts[5] > 0.5 * counts[0]


def test_stages_on_odd_documents(spark):
    passage, item = words(60, 21), words(20, 22)
    rows = [*texts()[:15], (50, f"{words(40, 23)} {passage}"), (51, f"{words(40, 24)} {passage}"), (52, f"{words(80, 25)} {item} {words(80, 26)}")]
    docs = frame(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["simhash near-dedup"](spark, docs, SF).collect()}
    assert 1 in kept and not {2, 3} & kept and {50, 51, 52} <= kept
    cut = {r.doc_id: r.text for r in stages["substring dedup"](spark, docs, SF).collect()}
    assert passage in cut[50] and passage not in cut[51] and cut[51].split() == words(40, 24).split()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = {r.doc_id: r.text for r in corpus_pipeline.decontaminate.remove_contamination(docs, bench).collect()}
    assert item not in clean[52] and clean[50] == rows[-3][1]
    packed = stages["best-fit packing"](spark, docs.where("doc_id > 49"), SF)
    assert packed.select("doc_id").distinct().count() == 3 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
