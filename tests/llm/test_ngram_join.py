"""The similarity join against brute force over all pairs, its filters, and odd tables."""

import random

import numpy as np
import pyarrow as pa

from tallyspark.llm import ngram_join
from tallyspark.llm.ngram_join import similarity_join


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(docs):
    sets = [brute_set(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (i, _), g in zip(docs, group):
        low[g] = min((x for x in (i, low.get(g)) if x is not None), default=None)
    return sorted(((i, len(s), low[g]) for (i, _), s, g in zip(docs, sets, group)), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def families():
    """Chains that drift over the limit, copies on both sides of it, a shared passage, and short, odd and empty texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(80)]
    texts = [None, "", " \t", "a", "A", "a b", "A  B", "b a", "a b c", "a b c a b c a b c", "c a b c a b", "x " * 500, "X\n" * 300, "Ä b c", "ä b c"]
    for size in (40, 150, 400):
        text = [rng.choice(words) for _ in range(size)]
        for _ in range(25):
            texts.append(" ".join(text))
            text[rng.randrange(size)] = rng.choice(words)
        for n in (1, 2, 3, 4, 5, 7, 9, 14):
            for _ in range(5):
                copy = list(text)
                for at in rng.sample(range(size), n):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
        for cut in (1, 3, size // 20, size // 12, size // 8):
            texts += [" ".join(text[cut:]), " ".join(text[:-cut]), " ".join(text + text[:cut])]
    texts += [" ".join(passage + [rng.choice(words) for _ in range(n)]) for n in (1, 2, 3, 5, 8, 9, 10, 20, 40, 80) for _ in range(4)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_join_equals_brute_force(spark):
    docs = families()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = brute(docs)
    assert rows(similarity_join(d)) == expected
    assert rows(similarity_join(d, counters=4)) == expected  # another order, the same links


def test_one_family_and_a_loose_one(spark):
    """Many near copies of one text, and many texts that share most of their words but not enough."""
    rng = random.Random(2)
    base, loose = [f"b{i}" for i in range(120)], [f"l{i}" for i in range(60)]
    texts = []
    for k in range(150):
        copy = list(base)
        copy[rng.randrange(120)] = f"new{k}"
        texts.append(" ".join(copy))
        texts.append(" ".join(loose + [f"t{k}_{j}" for j in range(20)]))
    docs = list(enumerate(texts))
    assert rows(similarity_join(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_filters_keep_what_links():
    """At the first shared shingle of two sets that link, position and suffix bounds allow the pair."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(3, 400))
        base = rng.integers(0, 2**63, size=n, dtype=np.uint64)
        drop, more = int(rng.integers(0, n // 10 + 1)), int(rng.integers(0, n // 10 + 1))
        x, y = np.unique(base), np.unique(np.concatenate([base[drop:], rng.integers(0, 2**63, size=more, dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common < 90 * (len(x) + len(y) - common):
            continue
        counts = rng.integers(0, 5, size=64)
        x, y = (ngram_join.ordered(s, counts) for s in (x, y))
        kx, ky = ngram_join.prefix_size(len(x)), ngram_join.prefix_size(len(y))
        shared = [(i, j) for i in range(kx) for j in range(ky) if x[i] == y[j]]
        assert shared
        i, j = shared[0]
        bx, by = (ngram_join.suffix_classes(s, k).view(np.uint8).reshape(-1, 8)[at].astype(int) for s, k, at in ((x, kx, i), (y, ky, j)))
        gap = abs(bx - by)
        bound = 1 + min(len(x) - i - 1, len(y) - j - 1, (len(x) - i - 1 + len(y) - j - 1 - int(np.minimum(gap, 256 - gap).sum())) // 2)
        assert bound >= common


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows(similarity_join(empty)) == []
    docs = [(None, "one two three four"), (7, "One two three  four"), (7, "other words are here"), (7, "other words are here"), (None, "nobody else has this"), (None, None), (3, None), (9, "")]
    d = spark.createDataFrame([(i, t, 1, "n", 2.0, 5) for i, t in docs], "doc_id long, text string, node int, token string, rank double, n int")
    assert rows(similarity_join(d)) == brute(docs)


def test_a_long_text_in_pieces(spark):
    """A text longer than a piece is one set; its near copy links."""
    rng = random.Random(4)
    words = [f"long{rng.randrange(10**6)}" for _ in range(250_000)]
    other = list(words)
    for at in rng.sample(range(250_000), 3000):
        other[at] = "changed"
    assert len(" ".join(words)) > 2 << 20
    docs = [(1, " ".join(words)), (2, " ".join(other)), (3, "short one here")]
    got = similarity_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(docs)
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}
    assert len(ngram_join.shingle_sets(pa.array([docs[0][1]]))[0]) == len(brute_set(docs[0][1]))
