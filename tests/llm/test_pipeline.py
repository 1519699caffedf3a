import os

import pytest

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_stages_keep_the_columns_and_shrink(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            counts.append(docs.count())
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.3 * counts[0]
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_decontamination_learns_from_every_document(spark, tmp_path, monkeypatch):
    from tallyframe.llm import latent_leaks

    seen, fit = [], latent_leaks.latent_space
    monkeypatch.setattr(latent_leaks, "latent_space", lambda rows, *a: seen.append(rows.count()) or fit(rows, *a))
    spark.createDataFrame([(i, f"item {i} of the benchmark") for i in range(5)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} and w{i % 11}") for i in range(2500)], "doc_id long, text string")
    assert dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, docs, str(tmp_path)).count() == 2500
    assert seen == [2505]  # a row per document and item; a sample of 1,000 documents has fewer
