"""Terms of texts in one pass: the same as by the expressions of tokens and vocabulary, and no token is shuffled."""

import random

from pyspark.sql import functions as F

from tallyspark.functions.questions import salient_tokens
from tallyspark.operators import terms

WORDS = "tariffs tariff policies companies 12abc3 a1 1a q12 tm1128y17 tm1128y17verylongcode x1 news skies sky asking the they'll usa été naïve war wars covid19 bets bet prices-of _under_ glass buses as is 2026 3rd b2b economics"


def test_terms_equal_those_of_tokens_and_vocabulary(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(WORDS.split()) for _ in range(rng.randint(0, 30))) + rng.choice(["", ".", " -", "\t"])) for i in range(200)] + [(200, ""), (201, None), (202, "x" * 300 + " war")]
    df = spark.createDataFrame(texts, "i long, t string")
    tokens = df.select("i", F.posexplode(F.array_distinct(salient_tokens(F.col("t")))).alias("_at", "token"))
    placed = terms.with_terms(tokens).collect()
    expected = {i: [] for i, _ in texts}
    for r in sorted(placed, key=lambda r: r["_at"]):
        if r["key"] not in [k for k, _ in expected[r["i"]]]:
            expected[r["i"]].append((r["key"], r["label"]))
    got = {r["i"]: [(t["key"], t["label"]) for t in r["_own"]] for r in terms.with_own_terms(df, "t").collect()}
    assert got == expected and sum(map(len, got.values())) > 800


def test_terms_of_texts_are_not_shuffled(spark):
    """Every token of all texts was a row, read twice, joined and put together again."""
    df = spark.createDataFrame([(1, "Tariffs on steel and taxes")], "i long, t string")
    spark.sparkContext.setJobGroup("terms", "terms")
    assert [t["key"] for t in terms.extract_terms(df, "i", "t").first()["terms"]] == ["tariff", "steel", "tax"]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("terms")
    stages = [s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(stages) <= 3, stages
