import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:3]:
        kept = pipeline.written(stage(spark, docs, SF), "test")
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert kept.join(docs, docs.columns, "left_anti").count() == 0
        docs = kept
    texts = [r["text"].lower() for r in docs.collect()]
    assert len(texts) == len(set(texts))
    rows = pipeline.run(spark, SF).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    assert set(rows.doc_id) <= {r["doc_id"] for r in docs.collect()}
