from __future__ import annotations

import corpus_pipeline


def test_stages_keep_columns_and_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "source_mixing", "best_fit_packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_rows_without_an_id_of_their_own(spark):
    text = lambda k: " ".join(f"w{k}x{i * i % 101}" for i in range(30))
    rows = [(None, text(1), "a"), (None, text(2), "a"), (None, text(3), "b"), (5, text(4), "a"), (5, text(5), "b"), (5, text(6), "b"), (2, text(6), "b"), (None, text(6), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where(~docs.text.eqNullSafe(text(6)) | docs.doc_id.eqNullSafe(2)).collect()))


def test_mix_keeps_its_budget_without_ids(spark):
    rows = [(None if k % 2 else 7, " ".join(["w"] * (k % 9 + 1)), "abc"[k % 3]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert 0.9 * words(docs) <= words(corpus_pipeline.source_mixing(spark, docs, "")) <= words(docs)
