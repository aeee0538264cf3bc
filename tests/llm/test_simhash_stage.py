"""The near-copy stage begins with SimHash: links of two bits are found by fingerprints, checked by Jaccard."""

import random

from pyspark.sql import functions as F

from tallyspark.llm import similar, simhash
from tests.llm.test_similar import brute_survivors, near_copies


def test_stage_finds_links_by_simhash_alone(spark, monkeypatch):
    """Without any min-hash key the copies within two bits are still found, and only those that are near copies."""
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(1500)]
        texts += [" ".join(text), " ".join(text[:-1] + ["other"]), " ".join(text[:700] + ["x", "y"] + text[700:])]
    rows = list(enumerate(texts))
    prints = [simhash.fingerprint(t) for t in texts]
    # two texts of unlike words with one fingerprint: no near copies (a repeated shingle sets all bits)
    rows += [(100, "a b c " * 400 + "d e f"), (101, "a b c " * 400 + " ".join(words[:9]))]
    made = similar.sketches
    monkeypatch.setattr(similar, "sketches", lambda df, text_col: made(df, text_col).withColumn("bands", F.array().cast("array<bigint>")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    within = {(i, j) for j in range(36) for i in range(j) if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 2}
    group = list(range(36))
    for i, j in within:
        group = [group[i] if g == group[j] else g for g in group]
    assert len(within) >= 6 and {i for i in kept if i < 100} == {min(k for k in range(36) if group[k] == g) for g in set(group)}
    assert {100, 101} <= kept


def test_pairs_of_simhash_connect_all_within_two_bits(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = similar.sketches(docs, "text").groupBy("node").agg(F.min("n_shingles").alias("n"), F.first("fingerprint").alias("fingerprint"))
    got = {(r["a"], r["b"]) for r in similar.simhash_pairs(nodes).collect()}
    of = {r["node"]: (r["n"], r["fingerprint"]) for r in nodes.collect()}
    assert all(bin((of[a][1] ^ of[b][1]) & (1 << 64) - 1).count("1") <= 2 for a, b in got) and len(got) > 20
    kept = {r["doc_id"] for r in similar.keep_one_of_similar(docs).collect()}
    assert kept == brute_survivors(rows)
