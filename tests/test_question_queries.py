"""Queries over all observations against brute force."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.rules import CATALOG
from tallyspark.operators import terms
from tallyspark.plans import workloads
from tallyspark.queries import QUERIES

from .test_polls import direct_clusters


@pytest.fixture(scope="module")
def seen(spark, sf_dir):
    return workloads.observations(spark, sf_dir)


def test_clusters_of_all_candidates(spark, sf_dir, seen):
    rest = seen.where(F.col("topic_id").startswith("headline-candidate-"))
    found = {r["obs_id"]: r for r in terms.observation_terms(rest).collect()}
    order = {r["obs_id"]: r["obs_ord"] for r in rest.select("obs_id", "obs_ord").collect()}
    rows = sorted((order[i], r["intent"] or "", list(r["features"])) for i, r in found.items())
    got = QUERIES["question_clusters"](spark, sf_dir).collect()
    assert {r["obs_ord"]: r["cluster"] for r in got} == direct_clusters(rows)
    ids = defaultdict(set)
    for r in got:
        ids[r["cluster"]].add((r["topic_id"], r["topic_label"]))
    assert all(len(own) == 1 for own in ids.values()) and len({next(iter(own))[0] for own in ids.values()}) == len(ids)


def test_headlines_of_all_observations(spark, sf_dir, seen):
    """Topics outside the catalogue of two polls or more, after candidates got their clusters' ids; a poll is a source, collection and date."""
    clusters = {r["obs_ord"]: r["topic_id"] for r in QUERIES["question_clusters"](spark, sf_dir).collect()}
    polls, counts = defaultdict(set), defaultdict(int)
    for r in seen.collect():
        topic = clusters.get(r["obs_ord"], r["topic_id"])
        if topic not in dict(CATALOG):
            polls[topic].add((r["source_id"], r["source_collection"], r["poll_date"]))
            counts[topic] += 1
    sources = {t: sorted({p[0] for p in own}) for t, own in polls.items()}
    expected = {t: (counts[t], len(own), len(sources[t]), ",".join(sources[t])) for t, own in polls.items() if len(own) >= 2}
    got = {r["topic_id"]: (r["observation_count"], r["poll_count"], r["source_count"], r["sources"]) for r in QUERIES["headline_workload"](spark, sf_dir).collect()}
    assert got == expected and len(got) > 1
