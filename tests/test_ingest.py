"""Ingest over several batches, failing sources, the stored index, and single topics."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.rules import CATALOG
from tallyspark.operators import headlines, polls, question_index as qi
from tallyspark.streaming import ingest

SCHEMA = "source_id string, article_url string, seen_at timestamp, title string"


def test_a_release_past_the_watermark_is_stored_once(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    days = [("2024-01-01", "u"), ("2024-02-01", "v"), ("2024-04-01", "u"), ("2024-04-02", "w"), ("2024-04-02", "w")]
    for day, url in days:
        own = spark.createDataFrame([("s", url, f"{day} 00:00:00", "t")], "source_id string, article_url string, seen_at string, title string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
        own.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.start_ingest(stream, store, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted(r["article_url"] for r in spark.read.parquet(store).collect()) == ["u", "v", "w"]


def test_sources_that_fail_become_warnings(spark, tmp_path):
    good = lambda: spark.createDataFrame([(1,)], "n int")
    rows, warnings = polls.load_sources(spark, {"a": good, "b": lambda: spark.read.parquet(f"{tmp_path}/none"), "c": good})
    assert sorted((r["source_id"], r["source_rank"], r["n"]) for r in rows.collect()) == [("a", 0, 1), ("c", 1, 1)]
    (only,) = warnings.collect()
    assert only["source_id"] == "b" and only["warning"].startswith("b unavailable: ")
    assert polls.load_sources(spark, {})[0] is None


def test_index_store(spark, tmp_path):
    schema = "question_fingerprint string, source_id string, confidence double"
    path = f"{tmp_path}/index"
    assert qi.read_index(spark, path, schema).count() == 0
    qi.write_index(spark.createDataFrame([(f"{i:02d}", "s", 0.5) for i in range(40)], schema), path, 4)
    qi.write_index(spark.createDataFrame([("07", "s", 0.9)], schema), path, 4)
    stored = {r["question_fingerprint"]: r["confidence"] for r in qi.read_index(spark, path, schema).collect()}
    assert stored["07"] == 0.9 and 0 < len(stored) < 40  # only the bucket of 07 was replaced
    assert [r["question_fingerprint"] for r in qi.first_questions(qi.read_index(spark, path, schema), 3).collect()] == sorted(stored)[:3]
    with pytest.raises(Exception):
        qi.read_index(spark, "nosuchscheme://x/y", schema)


def test_topic_of_the_catalogue_or_of_the_first_observation(spark):
    seen = spark.createDataFrame([("headline-x", "Later", 5), ("headline-x", "First", 2)], "topic_id string, topic_label string, obs_ord long")
    assert headlines.topic_summary(seen, "headline-x")["topic_label"] == "First"
    assert headlines.topic_summary(seen, CATALOG[0][0]) == {"topic_id": CATALOG[0][0], "topic_label": CATALOG[0][1], "status": "stable"}
    with pytest.raises(LookupError):
        headlines.topic_summary(seen, "headline-y")
