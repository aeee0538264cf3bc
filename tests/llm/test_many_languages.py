"""Language identification with many languages: groups of them, one at a time, equal all of them at once."""

import random
import tracemalloc

from pyspark.sql import functions as F

from tallyspark.llm import language

LANGUAGES = [f"l{i:03d}" for i in range(200)]


def text_of(lang: str, seed: int, words: int = 40) -> str:
    """Words of a language, each drawn from its own list of thirty."""
    own = random.Random(lang)
    known = ["".join(own.choice("abcdefghijklmnoprstuvwyz\u00e9\u0434") for _ in range(own.randint(3, 8))) for _ in range(30)]
    rng = random.Random(seed)
    return " ".join(rng.choice(known) for _ in range(words))


def test_two_hundred_languages_in_bounded_tables(spark):
    learn = spark.createDataFrame([(k * 1000 + i, text_of(x, k), x) for k in range(4) for i, x in enumerate(LANGUAGES)], "doc_id long, text string, lang string")
    odd = [(1, None), (2, ""), (3, "12 34"), (4, text_of("l007", 77)), (4, text_of("l007", 77))]
    rows = [(i, x) for i, x in odd] + [(10 + i, text_of(x, 99, 25)) for i, x in enumerate(LANGUAGES)]
    docs = spark.createDataFrame([(i, x, "kept", i * 2) for i, x in rows], "doc_id long, text string, lang_pred string, _row long")

    cells = 2_000_000
    trees = language.learn_languages(learn, cells=cells)
    sizes = {r["language"]: r["count"] for r in trees.counts.groupBy("language").count().collect()}
    assert [x for g in trees.groups for x in g] == LANGUAGES and 3 <= len(trees.groups) <= 40
    assert all(sum(sizes[x] for x in g) * len(g) <= cells for g in trees.groups)
    tracemalloc.start()
    model = trees.model(trees.groups[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x.size for x in model.cost) <= cells + 256 * len(trees.groups[0]) + 1 and peak <= 80 * cells

    found = language.identify_language(docs, trees)
    assert found.columns == ["doc_id", "text", "_row", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows) and all(got[i]["_row"] == i * 2 for i in got)
    assert {(got[i]["lang_pred"], got[i]["score"]) for i in (1, 2, 3)} == {("und", 0.0)} and got[4]["lang_pred"] == "l007"
    assert sum(got[10 + i]["lang_pred"] == x for i, x in enumerate(LANGUAGES)) >= 198

    whole = language.PpmModel(trees.counts.toArrow().to_pandas(), LANGUAGES, trees.order)
    names, scores = whole.predict([x for _, x in rows])
    for (i, _), name, score in zip(rows, names, scores):
        assert got[i]["lang_pred"] == name and abs(got[i]["score"] - score) < 1e-3


def test_groups_of_one_language_each_and_ties(spark):
    text = "one and the same text"
    learn = spark.createDataFrame([(1, text, "b"), (2, text, "a"), (3, "something else altogether", "c")], "doc_id long, text string, lang string")
    trees = language.learn_languages(learn, cells=1)
    assert trees.groups == [["a"], ["b"], ["c"]]
    row = language.identify_language(learn.select("doc_id", "text"), trees).where("doc_id = 1").first()
    assert row["lang_pred"] == "a" and abs(row["score"] - 0.5) < 1e-3
    empty = language.identify_language(learn.select("doc_id", "text").where(F.lit(False)), trees)
    assert empty.count() == 0 and [f.dataType.simpleString() for f in empty.schema] == ["bigint", "string", "string", "double"]
