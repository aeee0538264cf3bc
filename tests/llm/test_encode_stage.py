"""The encoding stage: one pass over the texts, with the ids and round trips of the two operators."""

from pyspark.sql import functions as F

from tallyspark.llm.bpe import bpe_decode, bpe_encode
from tallyspark.llm.queries import tokenizer_path


def test_encode_is_one_pass_and_sends_no_text_back(spark):
    import corpus_pipeline

    texts = [None, "", "plain words", "é ﷽ 漢字\x00", "<|endoftext|> in a text", "tail � " * 50]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    staged = corpus_pipeline.encode(spark, docs, "")
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan  # two in a row are two workers, each with a tokenizer, for one task
    assert not any("text#" in line for line in plan.split("\n")[: next(i for i, line in enumerate(plan.split("\n")) if "MapInArrow" in line)])
    both = bpe_decode(bpe_encode(docs, tokenizer_path()), tokenizer_path())
    expected = {r["doc_id"]: (bytes(r["ids"]), r["n_tokens"], r["same"]) for r in both.withColumn("same", F.col("decoded") == F.coalesce("text", F.lit(""))).collect()}
    assert {r["doc_id"]: (bytes(r["ids"]), r["n_tokens"], r["round_trip"]) for r in staged.collect()} == expected
    assert staged.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
