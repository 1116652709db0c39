"""The pipeline's stages take effect, and its result is what packing gives for what the stages keep."""

import corpus_pipeline
from dqlens.llm import jaccard, quality


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    ids = [{r.doc_id for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            assert {r.doc_id for r in quality.quality(before).where("kept").collect()} == {r.doc_id for r in docs.collect()}
        if k == 2:
            assert {r.component_id for r in jaccard.jaccard(before).collect()} == {r.doc_id for r in docs.collect()}
        ids.append({r.doc_id for r in docs.collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert len(toxic & ids[1]) <= 0.3 * len(toxic & ids[0])
    assert ids[4] == ids[5] and docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
