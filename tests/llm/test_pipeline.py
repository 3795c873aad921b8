
import corpus_pipeline
from weftmark.llm import exact_dedup, simhash

DATA = "/root/testdata/sf0.001"


def test_each_stage_acts_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = spark.createDataFrame([(10_000, "123 456", None, "s", 7), (10_001, None, None, "s", 0)], docs.schema)
    docs = docs.unionByName(junk)
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, DATA).cache()
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}
            continue
        assert out.columns == docs.columns and out.exceptAll(now).count() == 0
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert len(kept) == out.count()
        gone = {r.doc_id for r in now.select("doc_id").collect()} - kept
        if name == "language_id":
            assert gone == {10_000, 10_001}
        elif name == "exact_dedup":
            assert exact_dedup.exact_dedup(out).where("NOT kept").count() == 0 and gone
        elif name == "simhash_near_dedup":
            assert simhash.simhash_dedup(out).where("component_id <> doc_id").count() == 0
        elif name == "mixing":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            clean = now.join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").count()
            assert out.join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").count() >= 0.9 * clean
        now = out


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
