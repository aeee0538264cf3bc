"""The keyed store: touched buckets only, two writers, lost writers and repeated batches; ingest and index by it."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import keyed_store as ks, question_index as qi
from tallyspark.streaming import ingest

SCHEMA = "k string, v int"


def largest(old, new):
    return old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"))


def content(spark, path):
    return {r["k"]: r["v"] for r in ks.read_store(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()}


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("part-*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(200)], SCHEMA)
    first = ks.merge_into_store(path, rows, ["k"], largest, 8)
    before = files(path)
    second = ks.merge_into_store(path, spark.createDataFrame([("k7", 1000), ("k8", 1)], SCHEMA), ["k"], largest, 99)
    touched = {b for b in range(8) if first.folders[b] != second.folders[b]}
    assert second.buckets == 8 and 1 <= len(touched) <= 2 and before <= files(path) and len(files(path) - before) == len(touched)
    assert content(spark, path) == {f"k{i}": i for i in range(200)} | {"k7": 1000}
    read = ks.read_version(spark, path, rows.schema, second, touched).inputFiles()
    assert all(second.folders[min(touched)] in f for f in read) and ks.unused_folders(spark, path) == []


def test_two_writers_follow_each_other(spark, tmp_path):
    path, calls = f"{tmp_path}/store", []
    one = spark.createDataFrame([("a", 1)], SCHEMA)

    def slow(old, new):
        calls.append(old.count())
        if len(calls) == 1:  # another writer commits in between
            ks.merge_into_store(path, spark.createDataFrame([("a", 5), ("b", 2)], SCHEMA), ["k"], largest, 1)
        return largest(old, new)

    assert ks.merge_into_store(path, one, ["k"], slow, 1).number == 2
    assert calls == [0, 2] and content(spark, path) == {"a": 5, "b": 2} and len(ks._names(spark, f"{path}/data")) == 2


def test_lost_writers_and_repeated_batches(spark, tmp_path):
    path = f"{tmp_path}/store"
    ks.merge_into_store(path, spark.createDataFrame([("a", 1)], SCHEMA), ["k"], largest, 4, number=1)
    again = ks.merge_into_store(path, spark.createDataFrame([("a", 9)], SCHEMA), ["k"], largest, 4, number=1)
    assert again.number == 1 and content(spark, path) == {"a": 1}
    Path(path, "versions", f"{2:012d}").write_text("4\n0 nowhere")  # no last line
    assert content(spark, path) == {"a": 1} and ks.newest_version(spark, path).number == 1
    with pytest.raises(RuntimeError):
        ks.merge_into_store(path, spark.createDataFrame([("a", 3)], SCHEMA), ["k"], largest, 4, number=2)
    assert ks.merge_into_store(path, spark.createDataFrame([("a", 3)], SCHEMA), ["k"], largest, 4, number=3).number == 3
    assert content(spark, path) == {"a": 3}
    assert content(spark, f"{tmp_path}/none") == {}


def test_snapshots_of_late_and_repeated_rows(spark, tmp_path):
    schema = "source_id string, article_url string, seen_at timestamp, title string"
    batches = [[("s", "u", 5, "five"), ("s", "v", 1, "one")], [("s", "u", 3, "late"), ("s", "w", 2, "two"), ("s", "w", 2, "TWO")], [("s", "u", 5, "five"), ("s", "v", 9, "nine")]]
    for batch in batches:
        own = spark.createDataFrame([(s, u, f"2024-01-0{d} 00:00:00", t) for s, u, d, t in batch], "source_id string, article_url string, seen_at string, title string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
        own.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.start_snapshots(stream, f"{tmp_path}/store", f"{tmp_path}/state", 4).awaitTermination(120)
    frame = spark.createDataFrame([], schema)
    got = {r["article_url"]: r["title"] for r in ks.read_store(spark, f"{tmp_path}/store", frame.schema).collect()}
    assert got == {"u": "five", "v": "nine", "w": "two"}


def test_index_upsert_keeps_other_files(spark, tmp_path):
    path, schema = f"{tmp_path}/index", "question_fingerprint string, model string"
    qi.upsert_stored(path, spark.createDataFrame([(f"{i:03d}", "old") for i in range(100)], schema), 8)
    before = files(path)
    last = qi.upsert_stored(path, spark.createDataFrame([("007", "new"), ("007", "later"), ("500", "new")], schema))
    stored = {r[0]: r[1] for r in ks.read_version(spark, path, spark.createDataFrame([], schema).schema, last).collect()}
    assert stored == {f"{i:03d}": "old" for i in range(100)} | {"007": "later", "500": "new"} and before <= files(path)
