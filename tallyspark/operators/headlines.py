"""Recurring headline topics: poll counts, summaries and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import CATALOG, catalog_table


def headline_summaries(observations: DataFrame, min_polls: int = 2, samples: int = 3) -> DataFrame:
    """Topics outside the catalog that occur in at least min_polls polls.

    observations: obs_ord, topic_id, topic_label, source_id, source_collection, poll_date (text or null), title.
    Distinct polls, sources and questions are each reduced to (topic, value) rows first, so that a topic with most of
    the rows is summed up before the shuffle; only then are topics put together.
    """
    rest = observations.where(~F.col("topic_id").isin(*[i for i, _ in CATALOG]))
    polls = rest.groupBy("topic_id", "source_id", "source_collection", F.coalesce("poll_date", F.lit("")).alias("_date")).agg(F.count("*").alias("_n"), F.max("poll_date").alias("_latest"), F.min(F.struct("obs_ord", "topic_label")).alias("_first"))
    by_source = polls.groupBy("topic_id", "source_id").agg(F.sum("_n").alias("_n"), F.count("*").alias("_polls"), F.max("_latest").alias("_latest"), F.min("_first").alias("_first"))
    topics = by_source.groupBy("topic_id").agg(
        F.min("_first")["topic_label"].alias("topic_label"), F.sum("_n").alias("observation_count"), F.sum("_polls").alias("poll_count"), F.count("*").alias("source_count"), F.array_join(F.sort_array(F.collect_list("source_id")), ",").alias("sources"), F.max("_latest").alias("latest_date")
    )
    asked = rest.groupBy("topic_id", "title").agg(F.min("obs_ord").alias("_at"))
    place = Window.partitionBy("topic_id").orderBy("_at")
    first = asked.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= samples).groupBy("topic_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "title"))), lambda x: x["title"]), " / ").alias("sample_questions"))
    return topics.where(F.col("poll_count") >= max(min_polls, 1)).join(first, "topic_id")


def headline_order() -> list[Column]:
    """Latest first, then the most observations; the id decides ties."""
    return [F.col("latest_date").desc_nulls_last(), F.col("observation_count").desc(), F.col("topic_id")]


def topic_summary(observations: DataFrame, topic_id: str) -> dict[str, str]:
    """id, label and status of a topic: that of the catalogue, else that of its first observation; LookupError if it has none."""
    if topic_id in dict(CATALOG):
        return {"topic_id": topic_id, "topic_label": dict(CATALOG)[topic_id], "status": "stable"}
    first = observations.where(F.col("topic_id") == topic_id).agg(F.min_by("topic_label", "obs_ord").alias("label"), F.count("*").alias("n")).first()
    if not first["n"]:
        raise LookupError(f"topic not found: {topic_id}")
    return {"topic_id": topic_id, "topic_label": first["label"], "status": "headline"}


def lookup_topics(wanted: DataFrame, observations: DataFrame) -> DataFrame:
    """topic_id, topic_label and status of many topics at once: of the catalogue ("stable"), else of the first observation ("headline"), else null and "not found"."""
    first = observations.groupBy("topic_id").agg(F.min_by("topic_label", "obs_ord").alias("_own"), F.lit(True).alias("_seen"))
    known = wanted.select("topic_id").join(F.broadcast(catalog_table(wanted.sparkSession)), "topic_id", "left").join(first, "topic_id", "left")
    stable = F.col("catalog_label").isNotNull()
    return known.select("topic_id", F.coalesce("catalog_label", "_own").alias("topic_label"), F.when(stable, "stable").when(F.col("_seen"), "headline").otherwise("not found").alias("status"))
