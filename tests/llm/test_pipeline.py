import corpus_pipeline
from parasol.llm import decontamination, simhash


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        if name != "mix":
            assert docs.count() <= n
        n = docs.count()
        if name == "near_dedup":
            assert docs.count() == docs.dropDuplicates(["text"]).count()
            assert simhash.deduplicated(docs).count() == docs.count()
        if name == "decontaminate":
            assert decontamination.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == n and set(columns) <= set(last.columns)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
