"""A table of structures of all kinds to observations: topic or candidate, answers by demographic, cleaned wording, date, id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.questions import clean_for_source
from ..functions.rules import ROLLUP, catalog_table
from ..functions.text import iso_date_text
from ..shared import materialize
from .pooling import STRUCTURE, answers_of, chart_cells, panel_cells, with_topic
from .terms import headline_candidates

#: One row a structure; `type` says which columns count. A structure has a place (structure_idx) among all of its source (source_rank).
STRUCTURES = (
    "source_rank int, structure_idx long, source_id string, collection_title string, collection_subtitle string, "
    "type string, title string, prompt string, y_unit string, data string, x array<string>, y array<double>, "
    "slices array<struct<label:string,value:double>>, series array<struct<label:string,values:array<double>>>, "
    "panels array<struct<columns:array<string>,groups:array<struct<title:string,labels:array<string>>>,rows:array<struct<label:string,values:array<double>>>>>"
)
ANSWER = ("demographic_id", "demographic_label", "group_id", "group_label", "answer_id", "answer_label", "value")


def with_wording(structures: DataFrame) -> DataFrame:
    """Structures with the title and prompt that rules look at: a chart's prompt is its title, and a text's title is its first line."""
    first = F.substring_index(F.coalesce("data", F.lit("")), "\n", 1)
    title = F.when(F.col("type") == "Unstructured", first).otherwise(F.coalesce("title", F.lit("")))
    return structures.withColumns({"title": title, "prompt": F.when(F.col("type") == "Crosstab", F.coalesce("prompt", F.lit(""))).otherwise(title)})


def with_topic_or_candidate(asked: DataFrame) -> DataFrame:
    """Structures with topic_id, topic_label and compatibility: those of a rule, else a headline candidate; others are left out."""
    key = F.concat_ws(":", *STRUCTURE)
    matched = materialize(with_topic(asked).withColumn("obs_id", key), "matched-structures")
    found = headline_candidates(matched).select("obs_id", F.col("topic_id").alias("_id"), F.col("topic_label").alias("_label"))
    named = matched.join(found, "obs_id", "left").join(F.broadcast(catalog_table(asked.sparkSession)).select("topic_id", F.col("catalog_label").alias("_catalog")), "topic_id", "left")
    given = named.withColumns({"compatibility": F.coalesce("compatibility", F.lit(ROLLUP)), "topic_label": F.coalesce("_catalog", "_label", "topic_id"), "topic_id": F.coalesce("topic_id", "_id")})
    return given.where("topic_id is not null").drop("_id", "_label", "_catalog", "obs_id")


def structure_answers(structures: DataFrame, topics: DataFrame) -> DataFrame:
    """Answers of crosstabs and charts by demographic, in long form; texts and structures without a topic have none.

    topics: keys and topic_id. The structures are shuffled once, by their keys; what goes by them afterwards stays there.
    """
    own = structures.where("type <> 'Unstructured'").join(topics.select(*STRUCTURE, "topic_id"), list(STRUCTURE))
    keys = [*STRUCTURE, "source_id", "topic_id"]
    return answers_of(panel_cells(own.where("type = 'Crosstab'"), keys).unionByName(chart_cells(own, keys)))


def map_collection(structures: DataFrame) -> DataFrame:
    """One observation for each structure (STRUCTURES) that has a topic or terms, and answers.

    id is source:topic:index; answers is an array by demographic and answer; answer_text joins their ids and labels.
    """
    stored = materialize(structures, "structures")
    asked = with_wording(stored).select(*STRUCTURE, "source_id", "title", "prompt", "collection_title", "collection_subtitle")
    named = materialize(with_topic_or_candidate(asked), "structure-topics")
    long = structure_answers(stored, named)
    nested = long.groupBy(*STRUCTURE).agg(F.sort_array(F.collect_list(F.struct(*ANSWER))).alias("answers"))
    text = F.array_join(F.flatten(F.transform("answers", lambda a: F.array(a["answer_id"], a["answer_label"]))), " ")
    seen = named.join(nested, list(STRUCTURE))
    return seen.select(
        F.concat_ws(":", "source_id", "topic_id", F.col("structure_idx").cast("string")).alias("id"), *STRUCTURE, "source_id", "topic_id", "topic_label", "compatibility",
        F.col("collection_title").alias("source_collection"), F.col("collection_subtitle").alias("source_subtitle"),
        clean_for_source(F.col("source_id"), F.col("title")).alias("question_title"), clean_for_source(F.col("source_id"), F.col("prompt")).alias("prompt"),
        iso_date_text(F.concat_ws(" ", "title", "prompt", "collection_subtitle")).alias("poll_date"), "answers", text.alias("answer_text"),
    )
