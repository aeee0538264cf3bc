"""The registered queries of this subpackage: each applies an operator to its whole table and derives digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_round_trip
from .common import table
from .decontaminate import contaminated_pairs
from .language import predict_held_out
from .lexical_search import search
from .ngram_join import similarity_join
from .pii import BASE_KINDS, find_personal_data, span_text
from .prefix_trie import numbered_turns, prefix_trie, rebuilt_turns
from .quality_mil import classify_quality
from .quality_rules import quality_rules
from .sharding import shard_records
from .simhash import near_duplicates
from .url_filter import filter_urls
from .warc import archive_pages

#: The tokenizer file of the queries; a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe_round_trip(docs, tokenizer_path(), ["doc_id"], same_col=None, decoded_col="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of_kind = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of_kind(k) for k in BASE_KINDS], F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("pii_spans")).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_records(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "coverage", "exact")


def op10_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_held_out(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt_turns(numbered_turns(table(spark, sf_dir, "conversations"))))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality_attention": op2_quality_attention,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_ppm": op10_language_ppm,
    "op11_lexical_search": op11_lexical_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ngram_join": op13_ngram_join,
}

#: SHA-1 in base32: five bits at a time, of five hexadecimal digits for four letters.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '')"

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: CRC-32 of a decimal id: for each digit, eight steps of a shift and a conditional XOR.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: list_reduce(list_prepend(xor(c, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

#: DuckDB SQL for the rows of a query, where SQL can express them.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d""",
    "op11_lexical_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
        own AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
        total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM own),
        tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM own) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
        asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        parts AS (SELECT term, doc_id, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)) AS part FROM tf, total),
        scored AS (SELECT item_id, doc_id, sum(w * part)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY ALL),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 20""",
    "op12_prefix_trie": rf"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {_CRC32} & 3 AS h, count(*) AS size FROM t GROUP BY conv_id),
        given AS (SELECT c.conv_id, d.place, d.role, d.text FROM c JOIN t d ON d.conv_id = c.conv_id - c.conv_id % 20 AND d.place < c.h),
        k AS (SELECT c.conv_id, c.h, count(given.place) AS k FROM c LEFT JOIN given USING (conv_id) GROUP BY ALL),
        rebuilt AS (SELECT * FROM given UNION ALL SELECT conv_id, place - h + k, role, text FROM t JOIN k USING (conv_id) WHERE place >= h),
        paths AS (SELECT conv_id, place + 1 AS depth, list([role, text]) OVER (PARTITION BY conv_id ORDER BY place) AS path, text FROM rebuilt
            UNION ALL SELECT conv_id, 0, []::VARCHAR[][], '' FROM c),
        ends AS (SELECT conv_id, max(depth) AS depth, max_by(path, depth) AS path FROM paths GROUP BY conv_id),
        ended AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM ends GROUP BY path),
        nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words FROM paths GROUP BY path, depth),
        kids AS (SELECT path[1:depth - 1] AS path, count(*) AS children FROM nodes WHERE depth > 0 GROUP BY 1),
        counted AS (SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN kids USING (path)),
        below AS (SELECT path[1:k] AS path, count_if(children = 0) AS leaves, sum((n - 1) * words) AS saved
            FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted) GROUP BY 1)
        SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
        FROM counted v JOIN below USING (path) LEFT JOIN ended USING (path) LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[1:v.depth - 1]""",
    "op13_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, {_AZ}), '[^\x20\x09-\x0D]+') AS words FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN coalesce(len(words), 0) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles FROM w),
        sized AS (SELECT doc_id, shingles, len(shingles)::BIGINT AS n FROM sets),
        each AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM sized),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM each a JOIN each b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (n + m - c)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
        SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id FROM reach JOIN sized USING (doc_id) GROUP BY doc_id""",
}
