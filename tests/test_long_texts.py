"""Texts with very many different words, and documents with very many cells."""

import time

from tallyspark import shared
from tallyspark.operators import terms
from tallyspark.sources import toplines


def test_terms_of_a_text_with_many_words_take_linear_time(spark):
    names = ["".join(chr(98 + (n // 20**k) % 20) for k in range(5)) for n in range(40_000)]
    text = " ".join(["war", "prices", *names, "cost", names[0]])
    began = time.time()
    row = terms.extract_terms(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").first()
    assert time.time() - began < 60
    keys = [t["key"] for t in row["terms"]]
    assert keys[0] == "military-conflict" and keys[1] == "price" and len(set(keys)) == len(keys) > 30_000
    assert row["features"] == sorted(keys)


def test_cells_are_handed_on_in_bounded_batches(spark):
    text = "15. Support for the war\nSex Race Age Education\n" + "\n".join(f"Answer {chr(65 + k)} " + " ".join(["9%"] * 12) for k in range(20))
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").coalesce(1)
    cells = toplines.topline_cells(docs, "templates")
    sizes = toplines.cell_frames([docs.toPandas()], toplines.parse_by_templates, cells.columns)
    assert max(len(f) for f in sizes) < toplines.CELLS_AT_ONCE + 240
    assert cells.count() == 300 * 20 * 12


def test_wordings_that_many_ask_are_read_once(spark):
    asked = spark.createDataFrame([(f"o{i}", "gallup", "War and prices" if i % 2 else "Taxes on imported steel", "", None) for i in range(40)], "obs_id string, source_id string, title string, prompt string, topic_id string")
    found = terms.headline_candidates(asked)
    assert found.count() == 40 and found.select("topic_id").distinct().count() == 2
    alone = terms.extract_terms(asked.selectExpr("obs_id", "concat_ws(' ', title, prompt) as t"), "obs_id", "t")
    named = alone.select("obs_id", terms.label_of_terms(alone["terms"]).alias("label"))
    assert sorted(map(tuple, named.collect())) == sorted((r["obs_id"], r["topic_label"]) for r in found.collect())


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    assert shared.dealt(spark.range(1000).withColumnRenamed("id", "k"), "k").rdd.getNumPartitions() == 10
