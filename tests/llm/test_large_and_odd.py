"""Very long texts, one id on several texts, bounded samples at skewed keys, labelled figures, and the SQL of the queries."""

import random
import resource
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import common, decontaminate, language, quality_mil, quality_rules, similar, simhash, url_filter
from tallyspark.llm.queries import ORACLE_SQL, QUERIES


def test_queries_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    for name, sql in ORACLE_SQL.items():
        found, own = QUERIES[name](spark, sf_dir), con.sql(sql)
        columns = sorted(found.columns)
        assert columns == sorted(own.columns), name
        rows = [tuple(r) for r in found.select(*columns).collect()]
        own = own.select(*columns).fetchall()
        assert sorted(map(repr, rows)) == sorted(map(repr, own)), name


def test_samples_are_bounded_at_any_key(spark):
    hot = spark.range(60_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as k", "cast(id % 5 as string) as lang", "'x' as text")
    for seed in (0, 20, 30):
        rows = common.bounded_sample(hot, "k", 500, seed).collect()
        assert len(rows) == 500 and len({r["k"] for r in rows}) == 500
    assert common.bounded_sample(hot.where("k is null"), "k", 500).count() == 1
    within = common.bounded_sample(hot, "k", 50, within="lang").groupBy("lang").count().collect()
    assert len(within) == 5 and all(r["count"] <= 51 for r in within)
    assert common.bounded_sample(hot.limit(0), "k", 5).count() == 0


def test_one_id_on_unlike_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(1, a, 5), (1, b, 5), (0, c, 6), (2, c, 6), (2, a, 6), (1, a, 5)], "doc_id long, text string, own_fingerprint int")
    for kept in (simhash.keep_one_of_each(docs), similar.keep_one_of_similar(docs)):
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, c), (1, a), (1, b)]


def long_text(size: int) -> str:
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    part = " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n", " é"]) for _ in range(50_000))
    return (part + "\n") * (size // len(part) + 1)


def test_long_texts_in_pieces_equal_whole_ones(monkeypatch):
    text = long_text(1)
    whole = quality_rules.statistics(text), simhash.fingerprint(text), similar.sketch(pa.array([text, "a b"]))
    net = quality_mil.AttentionNet()
    scores = quality_mil.score_texts(net, [text, "short one"])
    windows = lambda: [b.to_pylist() for b in decontaminate.Windows().of(pa.array(["short. One two three four five six seven eight", text]))]
    own_windows = sorted(map(repr, sum(windows(), [])))
    counts = language.gram_counts
    model = language.PpmModel(small_counts(), ["xx", "yy"], 3)
    bits = model.bits([text.encode()])[0]
    for module in (common, quality_rules):
        monkeypatch.setattr(module, "PIECE", 5000)
    monkeypatch.setattr(quality_mil, "BLOCK", 4000)
    monkeypatch.setattr(quality_mil.passage_blocks, "__defaults__", (4000,))
    monkeypatch.setattr(common.pieces, "__defaults__", (5000,))
    monkeypatch.setattr(language, "BLOCK", 3000)
    monkeypatch.setattr(decontaminate, "BLOCK", 1000)
    assert (quality_rules.statistics(text), simhash.fingerprint(text), similar.sketch(pa.array([text, "a b"]))) == whole
    assert np.allclose(quality_mil.score_texts(net, [text, "short one"]), scores, rtol=1e-6)
    assert sorted(map(repr, sum(windows(), []))) == own_windows and counts
    assert np.allclose(model.long_bits(text.encode()), bits, rtol=1e-5)


def small_counts():
    import pandas as pd

    rows = []
    for lang, text in (("xx", b"abcab abc cab"), ("yy", b"dede ded abde")):
        for m in range(1, 5):
            grams, n = np.unique(language.gram_codes(np.frombuffer(text, dtype=np.uint8), m)[m - 1 :] & np.uint64((1 << 8 * m) - 1), return_counts=True)
            rows += [(lang, m, int(g), int(k)) for g, k in zip(grams, n)]
    return pd.DataFrame(rows, columns=["language", "length", "gram", "n"])


def test_long_texts_take_little_memory():
    text = long_text(24_000_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    net, model = quality_mil.AttentionNet(), language.PpmModel(small_counts(), ["xx", "yy"], 3)
    assert quality_rules.statistics(text)[0] > 3_000_000
    simhash.fingerprint(text)
    quality_mil.score_texts(net, [text])
    model.predict([text])
    similar.sketch(pa.array([text]))
    sum(1 for _ in decontaminate.Windows(wanted=np.array([5], dtype=np.uint64)).of(pa.array([text])))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 - before < 1200


def test_rules_catch_labelled_junk(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op4_quality_rules"](spark, folder).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    passed = [(q, rows[d]["kept"]) for d, q in labels if d in rows and not rows[d]["base_failed"]]
    good, bad = [k for q, k in passed if q == 1], [k for q, k in passed if q == 0]
    assert sum(good) >= 0.985 * len(good)
    assert len(bad) - sum(bad) >= 0.85 * len(bad)


def test_trees_judge_urls_of_unknown_hosts(spark):
    """Labels that follow from the form of a URL are learned; a quarter of the hosts is held out."""
    rng = random.Random(2)
    rows = []
    for i in range(1600):
        bad = rng.random() < 0.4
        host = f"h{i % 400}.{rng.choice(['com', 'org', 'net'])}"
        tail = "/".join(str(rng.randrange(10**6)) for _ in range(4)) + "?" + "&".join(f"p{k}={rng.randrange(999)}" for k in range(5)) if bad else "/".join(rng.choice(["about", "news", "team"]) for _ in range(2))
        rows.append((i, f"http://{host}/{tail}", "block" if bad else "allow", zlib.crc32(host.encode()) % 4 == 0))
    urls = spark.createDataFrame(rows, "page_id long, url string, verdict string, held boolean")
    judged = url_filter.filter_urls(urls.drop("verdict"), rules=(), labelled=urls.where("not held").select("url", "verdict"))
    held = [(r["verdict"], rows[r["page_id"]][2]) for r in judged.collect() if rows[r["page_id"]][3]]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.95 * len(held)


@pytest.mark.parametrize("text", ["", "one two"])
def test_pieces_of_short_texts(text):
    assert list(common.pieces(text)) == [text]
