"""Figures on rows that were not learned from: the forests' thresholds and the trees of URLs."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, quality_rules, url_filter


@pytest.fixture(scope="module")
def larger(sf_dir) -> str:
    """A table with enough labelled rows for figures of held-out ones."""
    return str(Path(sf_dir).parent / "sf0.1")


def test_rules_on_rows_without_part_in_the_thresholds(spark, larger):
    docs, labels = (common.table(spark, larger, n) for n in ("documents", "labels"))
    held = common.crc_mod("doc_id") == 0
    judged = quality_rules.quality_rules(docs, labels.where(~held)).join(labels.where(held), "doc_id").where("not base_failed")
    count = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    bad, good = (sum(count.get((q, k), 0) for k in (True, False)) for q in (0, 1))
    assert bad >= 40 and good >= 400
    assert count.get((0, False), 0) >= 0.9 * bad and count.get((1, False), 0) <= 0.02 * good


def test_urls_of_hosts_that_were_not_learned_from(spark, larger):
    pages = common.table(spark, larger, "pages").select("page_id", "url")
    ruled = url_filter.filter_urls(pages).select("page_id", "host", F.col("verdict").alias("truth"), "rule").where("rule is not null").join(pages, "page_id")
    ruled = common.materialize(ruled.withColumn("held", F.pmod(F.crc32("host"), F.lit(5)) == 0), "ruled-urls")
    learned = ruled.where("not held").select("url", F.col("truth").alias("verdict"))
    found = url_filter.filter_urls(ruled.where("held").select("page_id", "url"), rules=[], labelled=learned)
    rows = found.join(ruled.select("page_id", "truth"), "page_id").select("truth", "verdict").collect()
    right = sum(r["truth"] == r["verdict"] for r in rows)
    most = max(sum(r["truth"] == x for r in rows) for x in ("allow", "block"))
    assert len(rows) >= 100 and right > most and right >= 0.8 * len(rows)
