"""Personal data in texts with very many spans: equal to brute force, in bounded time; redaction; context over spans."""

import hashlib
import random
import time

from pyspark.sql import functions as F
from tests.llm.test_text_operators import brute_spans

from tallyspark.llm import pii
from tallyspark.llm.queries import ORACLE_SQL, QUERIES


def brute_redacted(text, spans):
    out, at = "", 0
    for start, _, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def redacted(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start:int,rank:int,end:int,kind:string>>")
    return {r["id"]: r["clean"] for r in df.select("id", pii.redact(F.col("text"), F.col("spans")).alias("clean")).collect()}


def test_redaction_equals_brute_force(spark):
    """Overlapping, nested, touching and equal spans, at both ends, few and more than a run of runs."""
    rng, rows = random.Random(1), []
    for k, n in enumerate([0, 1, 2, 3, 5, 17, 63, 64, 65, 300, 4095, 4096, 4097, 9000] * 3):
        text = "".join(rng.choice("ab é🙂c1") for _ in range(rng.randrange(1, 40) + 6 * n))
        spans = [(a := rng.randrange(len(text)), rng.randrange(6), min(len(text), a + rng.randrange(1, 12)), rng.choice(pii.KINDS)) for _ in range(n)]
        rows.append((k, text, sorted(spans)))
    rows.append((1000, "whole", [(0, 0, 5, "email")]))
    rows.append((1001, "abcdef", [(0, 0, 6, "email"), (1, 1, 2, "ip"), (3, 1, 6, "ip")]))
    got = redacted(spark, rows)
    assert all(got[k] == brute_redacted(t, s) for k, t, s in rows)


def test_long_texts_with_very_many_spans(spark):
    """24 MB with 500,000 spans, and the same in few and in many gaps: positions and redaction equal brute force."""
    rng = random.Random(2)
    made = ["mail a{0}@ex{0}.org", "10.0.{1}.{2}", "call +1 (555) 555-{3}", "visa 4111111111111111", "plain words here é"]
    part = lambda k: made[k % 5].format(k, k % 256, k % 199, 1000 + k % 9000)
    texts = [" ; ".join(part(k) + " filler text" * rng.randrange(4) for k in range(n)) for n in (40_000, 625_000)]
    assert len(texts[1]) > 24_000_000
    took = []
    for text in texts:
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        found = pii.find_personal_data(df)
        r = found.select("pii_spans", pii.redact(F.col("text"), F.col("pii_spans")).alias("clean")).collect()[0]
        took.append(time.time() - began)
        expected = brute_spans(text)
        spans = [(x["start"], x["rank"], x["end"], x["kind"]) for x in r["pii_spans"]]
        assert [x for x in spans if x[1] < 4] == expected and len(expected) >= 4 * len(text.split(" ; ")) // 5
        assert r["clean"].count("[EMAIL]") + r["clean"].count("[IP]") + r["clean"].count("[PHONE]") + r["clean"].count("[CARD]") >= len(expected) - 5
    assert took[1] < 60 + 40 * took[0]  # 16 times the text and spans


def test_context_reaches_over_other_spans(spark):
    """Words within 40 characters count, also behind other matches; farther ones and words inside a span don't."""
    ssn = "078-05-1120"
    texts = [f"ssn {ssn} {ssn} {ssn} {ssn} {ssn}", f"{ssn} {ssn} {ssn} {ssn} ssn", f"ssn {'x' * 36} {ssn}", f"ssn {'x' * 35} {ssn}", f"{ssn} {'x' * 35} ssn", f"{ssn} {'x' * 36} ssn", f"{ssn}"]
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()

    def near(text, start, end):
        words = (text[max(start - 41, 0) : start] + "\n" + text[end : end + 41]).replace("\n", " ").split(" ")
        return "ssn" in words

    for text, r in zip(texts, rows):
        starts = [i for i in range(len(text)) if text.startswith(ssn, i)]
        assert [x["start"] for x in r["pii_spans"]] == [i for i in starts if near(text, i, i + 11)]


def test_query_over_the_whole_table(spark, sf_dir):
    """Counts and hashes of the base of every document, by brute force."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and "op5_pii" not in ORACLE_SQL
    for r in rows:
        spans = brute_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[3] == k for s in spans) for k in pii.BASE_KINDS]
