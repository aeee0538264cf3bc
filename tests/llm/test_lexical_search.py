"""Ranked search against brute force, by small bundles and blocks, and against its SQL on the test tables."""

import math
import random
import re
from collections import Counter

from tallyspark.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, len(t), Counter(t)) for i, t in held if t]
    total, words = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in held:
            m = 75 + (25 * n * total) // words
            found.append((i, sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])))
        best = sorted((x for x in found if x[1] > 0), key=lambda x: (-x[1], x[0] is None, x[0]))[:top]
        out += [(item, k + 1, i, s) for k, (i, s) in enumerate(best)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def random_texts(rng, n, words):
    return [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(1, 40))) for _ in range(n)]


def test_search_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["Über", "straße", "ÉTÉ", "x_y", "日本語"]
    docs = list(enumerate(random_texts(rng, 400, words)))
    docs += [(1000 + i, "w0 w1 w2 rare w3") for i in range(60)]  # copies: ties by id
    docs += [(2000, None), (2001, ""), (2002, "?! --"), (2003, "w5 " * 3000 + "W5-w5"), (2004, "w7"), (2004, "w7 w8"), (None, "w7 w9 rare")]
    items = [(i, t) for i, t in enumerate(random_texts(rng, 30, words))] + [(100, "rare"), (101, None), (102, "nowhere"), (103, "W0, w0; RARE"), (103, "w0 w0 rare"), (None, "w9")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert rows(search(d, q)) == expected
    assert rows(search(d, q, bundle_items=5, block_rows=37)) == expected
    assert rows(search(d, q, max_sent=0, bundle_items=5, block_rows=37)) == expected
    assert rows(search(d, q, top=3)) == brute(docs, items, 3)


def test_items_whose_terms_end_early(spark):
    """Many documents, so that stages differ: items of rare terms only, of common ones only, and of both."""
    docs = [(i, f"common u{i} " + ("half " if i % 2 else "") + ("tenth " if i % 15 == 0 else "") + "pad " * (i % 7)) for i in range(1500)]
    items = [(0, "u7"), (1, "u7 u8 common"), (2, "tenth u15"), (3, "half"), (4, "u3 u3 tenth half common pad")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(search(d, q, block_rows=200)) == brute(docs, items)


def test_odd_tables(spark):
    """Empty tables, clashing extra columns, and a text longer than a piece."""
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(search(empty, items)) == []
    docs = [(1, "a " + "z" * 5), (2, "b A a " + "pad " * 600_000)]
    d = spark.createDataFrame([(i, t, 5, "x", 7.0, 3) for i, t in docs], "doc_id long, text string, row int, term string, score double, item_id int")
    assert rows(search(d, items)) == brute(docs, [(1, "a b")])
    assert rows(search(d, spark.createDataFrame([], "item_id long, text string"))) == []
    assert search(d, items).columns == ["item_id", "rank", "doc_id", "score"]
