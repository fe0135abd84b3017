import corpus_pipeline
from affilia.llm import jaccard, mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_their_parts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = (docs, out)
        if name != "best_fit_packing":
            assert out.columns == columns
        docs = out
    before, after = seen["quality_classifier"]
    scores = quality.score(before, quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    before, after = seen["jaccard_join"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in jaccard.join(before, 5, 80, 100).collect()}
    before, after = seen["secret_scan"]
    assert before.count() == after.count() and after.where("text rlike 'AKIA[A-Z0-9]{16}'").isEmpty()
    before, after = seen["source_mixing"]
    assert after.count() == sum(r.copies for r in mixing.rates(before).collect())
    before, after = seen["best_fit_packing"]
    assert after.where("piece = 0").count() == before.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
