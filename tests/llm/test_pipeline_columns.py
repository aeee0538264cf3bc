"""Stages of the pipeline keep the columns, values and session settings of their callers."""

import pytest
from pyspark.sql import functions as F

EXTRA = ("_spans", "_found", "_score", "_predicted", "_decoded", "_clean", "_email", "text_key", "node", "bands", "kept_id", "n_tokens", "ids", "score", "predicted", "weight", "item_key")


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontaminate", "personal_data", "encode"])
def test_clashing_names_and_settings(spark, sf_dir, name):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    setting = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    stage = dict(corpus_pipeline.STAGES)[name]
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in EXTRA})
    plain, rows = stage(spark, docs, sf_dir).collect(), stage(spark, wide, sf_dir).collect()
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == setting
    shared = [c for c in (docs.columns if name != "encode" else plain[0].asDict())]
    pick = lambda rows: sorted((tuple(r[c] for c in shared) for r in rows), key=repr)
    assert rows and pick(rows) == pick(plain)
    if name != "encode":
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in EXTRA)
