"""Near-duplicates, decontamination, archives and the pipeline against brute force on small tables."""

import base64
import gzip
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import xxhash

from tallyspark.llm import decontaminate, simhash, warc
from tallyspark.llm.queries import QUERIES
from tallyspark.operators.graph import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fingerprints):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    named = {g: min((ids[k] for k in range(len(ids)) if group[k] == g and ids[k] is not None), default=None) for g in set(group)}
    return [named[g] for g in group]


def test_fingerprints():
    for text in [None, "", "a", "A b", "a b c", "É x\x1cy \x85 z w", "one two three four five " * 9]:
        assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def docs_with_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    for k in range(160):  # near copies of one text
        words = (texts[0] + " " + texts[1] + " " + texts[2]).split()
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [None, "", " ", texts[3], texts[3], "short text"]
    return spark.createDataFrame([(None if i in (7, 203) else i * 3 % 211, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node int")


def check_components(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    source = docs.collect()
    assert len(rows) == len(source)
    prints = [simhash.fingerprint(r["text"]) % 2**64 for r in source]
    expected = sorted(zip([str(r["doc_id"]) for r in source], prints, map(str, brute_components([r["doc_id"] for r in source], prints))))
    assert sorted((str(r["doc_id"]), r["fingerprint"] % 2**64, str(r["component_id"])) for r in rows) == expected


def test_near_duplicates_equal_brute_force(spark):
    check_components(spark, docs_with_copies(spark))


def test_near_duplicates_by_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 1)
    check_components(spark, docs_with_copies(spark))


def test_links_of_chosen_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, size=30, dtype=np.uint64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, size=(8, 2))]
    values = np.unique(np.array([*map(int, base), *near], dtype=np.uint64))
    nodes = spark.createDataFrame([(int(v), k) for k, v in enumerate(values.view(np.int64))], "node long, rank long")
    expected = brute_components(list(range(len(values))), [int(v) for v in values])
    for bucket in (48, 1):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        roots = {r["node"]: r["rank"] for r in connected_components(nodes, simhash.near_links(nodes)).collect()}
        assert [roots.get(int(v), k) for k, v in enumerate(values.view(np.int64))] == expected


def test_threshold_allocation():
    costs = [{-1: 0.0, 0: 10.0, 1: 30.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 50.0, 1: 90.0}]
    cost, chosen = simhash.allocate(costs, 0)
    assert cost == 12.0 and chosen == [0, 1, -1]
    together = np.eye(64) * 50
    assert sorted(b for g in simhash.group_bits(together, 100, 3) for b in g) == list(range(64))


def test_keep_one_of_each(spark):
    docs = docs_with_copies(spark)
    kept = simhash.keep_one_of_each(docs).collect()
    source = docs.collect()
    groups = brute_components(list(range(len(source))), [simhash.fingerprint(r["text"]) % 2**64 for r in source])
    assert len(kept) == len(set(groups))
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    nodes = spark.range(200).selectExpr("id as node", "200 - id as rank")
    links = spark.range(99).selectExpr("id as a", "id + 1 as b")
    rows = connected_components(nodes, links).collect()
    assert {r["root"] for r in rows} == {99} and len(rows) == 100


ITEM = "Alice bought 5 apples for 3 dollars. Then Alice gave 2 apples to Bob and kept the rest of the apples at home."


def test_decontamination(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "what is the longest river here")], "item_id long, text string")
    other = ITEM.replace("Alice", "Carol").replace("5", "9").replace("Bob", "Dan")
    rows = [
        (1, "filler words first. " + ITEM + " more"), (2, "so. " + other), (3, None), (4, ""), (None, other.replace("9", "12")),
        (6, other.replace("Then Carol gave 2 apples to Dan", "Then Eve gave 7 apples to Eve")), (7, "what is the longest river here"), (8, "too short"), (9, "clean words " * 30), (2, "so. " + other), (10, ITEM.upper()),
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, window int")
    for sent in (decontaminate.MAX_SENT, 0):
        found = {(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.contaminated_pairs(docs, items, max_sent=sent).collect()}
        assert {(i, k) for i, k, _ in found} >= {(1, 1), (2, 1), (None, 1), (7, 4)}
        assert not {i for i, _, _ in found} & {3, 4, 6, 8, 9}
        assert (1, 1, True) in found and (2, 1, False) in found
    left = {r["doc_id"] for r in decontaminate.remove_contaminated(docs, items).collect()}
    assert {3, 4, 6, 8, 9} <= left and not left & {1, 2, 7, None}
    assert decontaminate.contaminated_pairs(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated_pairs(docs.limit(0), items).count() == 0


def test_benchmark_passages_in_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    expected = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontaminate"](spark, sf_dir).collect()}
    assert expected <= found and len(found - expected) <= 0.01 * len(docs)


PAGES = [(5, "http://a.b.c/x y%20\n?q#f", "<p>é"), (2, "http://a.b.c/", "<p>é"), (2, "http://a.b.c/", "<p>é"), (9, None, None), (None, "u", ""), (7, "https://www.Ex.com", "a\r\n\r\nWARC/1.1\r\n"), (-3, "x", "z" * 300000)]


def test_archives_round_trip(spark, sf_dir):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, path int")
    rows = warc.archive_pages(pages).collect()
    assert sorted(str(r["page_id"]) for r in rows) == sorted(str(p[0]) for p in PAGES)
    by_id = {r["page_id"]: r for r in rows}
    assert (by_id[5]["record_type"], by_id[5]["refers_to"], by_id[2]["record_type"], by_id[2]["refers_to"]) == ("revisit", 2, "response", None)
    assert by_id[None]["refers_to"] == 9 and by_id[9]["url"] is None and by_id[5]["url"] == PAGES[0][1]
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        assert (by_id[page_id]["payload_digest"], by_id[page_id]["payload_bytes"]) == (base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw))
        assert by_id[page_id]["payload"] == (None if by_id[page_id]["record_type"] == "revisit" else html or "")
    assert warc.archive_pages(pages.limit(0)).count() == 0
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert QUERIES["op3_warc"](spark, sf_dir).count() == table.count()


def test_archives_are_readable_gzip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/archives")
    raw = b"".join(gzip.open(p).read() for p in Path(tmp_path, "archives").glob("part-*"))
    assert raw.count(b"WARC-Record-ID:") == len(PAGES)


def test_index_finds_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_KEYS", 3)
    rows = [(f"k{i % 17:02d}", f"f{i % 3}", i, i + 1) for i in range(200)]
    index = warc.build_index(spark.createDataFrame(rows, "key string, path string, offset long, length long"))
    keys = spark.createDataFrame([(k,) for k in ("k00", "k05", "k16", "a", "k055", "z")], "key string")
    found = sorted((r["key"], r["path"], r["offset"]) for r in warc.lookup(index, keys).collect())
    assert found == sorted((k, p, o) for k, p, o, _ in rows if k in ("k00", "k05", "k16"))


def test_url_keys():
    assert warc.url_key("https://www.Example.com/a?b#c") == "com,example,www)/a?b" and warc.url_key(None) == "-" and warc.url_key("http://x.y") == "y,x)/"


def test_pipeline_against_its_parts(spark, sf_dir):
    """The stages one by one in plain Python, but for the trained classifier's scores; near copies by all pairs."""
    import corpus_pipeline
    from tests.llm.test_similar import brute_survivors

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    survivors = brute_survivors(sorted(kept.items()))
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = {i for i in survivors if not any(t in kept[i] for t in items)}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == expected and all(r["round_trip"] for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "encode"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
