import corpus_pipeline


def test_stages_keep_the_columns_and_every_decision(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in now.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        seen = set(ids)
    assert len(seen) > 120
    packed = corpus_pipeline.STAGES[-1][1](spark, now, d)
    assert {r.doc_id for r in packed.collect()} == seen
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
