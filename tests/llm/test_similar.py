"""Near copies of the pipeline against brute force over all pairs."""

import random

from tallyspark.llm import similar


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_survivors(rows):
    sets = [brute_shingles(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            alike = 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common)
            if alike and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}


def near_copies():
    """Two families of copies that drift apart step by step, looser and closer copies, and short and empty texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "  ", "a b", "A  b", "a b c", "x " * 400, "X " * 300]
    for family in range(2):
        text = [rng.choice(words) for _ in range(300)]
        for _ in range(60):  # a drifting chain
            texts.append(" ".join(text))
            text[rng.randrange(300)] = rng.choice(words)
        for n in (1, 3, 5, 6, 7, 8, 10, 14):
            for _ in range(6):
                copy = list(text)
                for at in rng.sample(range(300), n):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_equal_brute_force(spark):
    import corpus_pipeline

    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(brute_survivors(rows))


def test_near_copies_of_the_test_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(brute_survivors(rows))


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "only here"), (None, "only  Here"), (None, "with an id"), (4, "with an id"), (4, "with an id"), (5, "alone"), (None, None), (None, "")]
    kept = similar.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["4", "5", "None", "None"]
    assert {" ".join((r["text"] or "").lower().split()) for r in kept if r["doc_id"] is None} == {"", "only here"}
