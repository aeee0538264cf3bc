"""The question index: fingerprints, applying records, new questions, classifier output and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import hash16
from ..functions.questions import fingerprint_text, question_key
from .keyed_store import Version, merge_into_store
from ..functions.rules import CATALOG, ROLLUP, intent_of, structure_text, topic_match
from ..functions.text import label_from_topic_id, search_text, slug_id, trim_space
from ..shared import materialize

MIN_CONFIDENCE = 0.55
OUTPUT = "canonical_topic_id string, canonical_label string, intent string, subject array<string>, confidence double, exclude_reason string"


def fingerprint_input(title: Column, prompt: Column, answer_labels: Column) -> Column:
    """What a fingerprint is the hash of: the wording and its sorted answers."""
    return F.concat_ws("|", F.lit("v1"), question_key(fingerprint_text(title, prompt)), F.array_join(answer_labels, "|"))


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Add question_fingerprint of title, prompt and answer_labels; the text is written first, so that the hash runs on a plain column."""
    wrote = materialize(df.withColumn("_input", fingerprint_input(F.col("title"), F.col("prompt"), F.col("answer_labels"))), "fingerprint-inputs")
    return wrote.withColumn("question_fingerprint", hash16(F.col("_input"))).drop("_input")


def answer_label_sets(answers: DataFrame, key: str = "obs_id") -> DataFrame:
    """Sorted distinct "id: label" of each observation."""
    return answers.groupBy(key).agg(F.sort_array(F.collect_set(F.concat_ws(": ", "answer_id", "answer_label"))).alias("answer_labels"))


def applicable_topic(record_id: Column, label: Column, confidence: Column, exclude: Column) -> Column:
    """Topic id that a record gives; null if it is excluded, unsure or empty."""
    given = trim_space(F.coalesce(record_id, F.lit("")))
    own = slug_id(F.when(given == "", trim_space(F.coalesce(label, F.lit("")))).otherwise(given))
    full = F.when(own.isin(*[i for i, _ in CATALOG]) | own.startswith("headline-"), own).otherwise(F.concat(F.lit("headline-"), own))
    return F.when(exclude.isNull() & (confidence >= MIN_CONFIDENCE) & (own != ""), full)


def apply_index(observations: DataFrame, index: DataFrame) -> DataFrame:
    """Observations with topics of applicable records in place of candidates' own; `applied` says which."""
    topic = applicable_topic(F.col("canonical_topic_id"), F.col("canonical_label"), F.col("confidence"), F.col("exclude_reason"))
    named = F.trim(F.coalesce("canonical_label", F.lit("")))
    records = index.withColumn("_topic", topic).where("_topic is not null").select("question_fingerprint", "_topic", F.when(named != "", named).otherwise(label_from_topic_id(F.col("_topic"))).alias("_label"))
    joined = observations.join(records, "question_fingerprint", "left")
    hit = F.col("topic_id").startswith("headline-candidate-") & F.col("_topic").isNotNull()
    applied = F.coalesce(hit, F.lit(False))
    changed = joined.withColumn("applied", applied).withColumns({"topic_id": F.when(F.col("applied"), F.col("_topic")).otherwise(F.col("topic_id")), "topic_label": F.when(F.col("applied"), F.col("_label")).otherwise(F.col("topic_label")), "compatibility": F.when(F.col("applied"), F.lit(ROLLUP)).otherwise(F.col("compatibility"))})
    return changed.drop("_topic", "_label")


def new_questions(observations: DataFrame, index: DataFrame, refresh: bool = False) -> DataFrame:
    """Candidates whose fingerprint has no record, one row each (the first observation)."""
    rest = observations.where(F.col("topic_id").startswith("headline-candidate-"))
    if not refresh:
        rest = rest.join(index.select("question_fingerprint"), "question_fingerprint", "left_anti")
    others = [c for c in rest.columns if c != "question_fingerprint"]
    return rest.groupBy("question_fingerprint").agg(F.min_by(F.struct(*others), "obs_ord").alias("_r")).select("question_fingerprint", "_r.*")


def parse_output(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add the fields of a classifier's reply, normalised; `rejected` where it holds no JSON object."""
    text = F.trim(F.substring_index(F.col(raw_col), "</think>", -1))
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = df.withColumn("_o", F.from_json(F.nullif(found, F.lit("")), OUTPUT, {"mode": "PERMISSIVE"}))
    blank = lambda c: trim_space(F.coalesce(F.col(f"_o.{c}"), F.lit("")))
    shown = F.coalesce("_o.confidence", F.lit(0.0))
    confidence = F.least(F.greatest(F.when((shown > 1) & (shown <= 100), shown / 100).otherwise(shown), F.lit(0.0)), F.lit(1.0))
    subject = F.array_distinct(F.filter(F.transform(F.coalesce("_o.subject", F.array().cast("array<string>")), slug_id), lambda s: s != ""))
    out = parsed.withColumns({"canonical_label": blank("canonical_label"), "intent": blank("intent"), "subject": subject, "confidence": confidence, "_id": blank("canonical_topic_id"), "_why": F.nullif(blank("exclude_reason"), F.lit(""))})
    named = F.when((F.col("_id") == "") & (F.col("canonical_label") != ""), F.concat(F.lit("headline-"), slug_id(F.col("canonical_label")))).otherwise(F.col("_id"))
    out = out.withColumn("canonical_topic_id", named).withColumn("exclude_reason", F.when((F.col("canonical_topic_id") == "") & F.col("_why").isNull(), "model returned no canonical topic id").otherwise(F.col("_why")))
    rejected = F.col("_o").isNull() | ((F.col("_o.canonical_topic_id").isNull()) & F.col("_o.canonical_label").isNull() & F.col("_o.confidence").isNull() & F.col("_o.exclude_reason").isNull() & F.col("_o.subject").isNull() & F.col("_o.intent").isNull() & ~found.rlike(r"^\{\s*\}$"))
    return out.withColumn("rejected", rejected).drop("_o", "_id", "_why")


def review_status(exclude: Column, confidence: Column) -> Column:
    return F.when(exclude.isNotNull(), "excluded").when(confidence < MIN_CONFIDENCE, "needs-review").otherwise("accepted")


Classifier = Callable[[pd.DataFrame], pd.Series]


def classify(questions: DataFrame, classifier: Classifier, model: str) -> DataFrame:
    """Call a classifier once for each question, in batches, and parse its replies.

    classifier: from a batch of question_fingerprint, title, prompt, source_id and answer_labels to one reply a row.
    """
    columns = ["question_fingerprint", "source_id", "title", "prompt", "answer_labels"]
    schema = questions.select(*columns).schema.add("raw", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(raw=classifier(batch))

    asked = questions.select(*columns).mapInPandas(run, schema)
    return parse_output(asked).withColumn("model", F.lit(model)).withColumn("review_status", review_status(F.col("exclude_reason"), F.col("confidence")))


def classify_by_rules(questions: DataFrame) -> DataFrame:
    """The default classifier: topic rules and intents, as expressions; records like those of classify()."""
    text = structure_text(F.col("title"), F.col("prompt"))
    hit = topic_match(F.col("source_id"), text)
    intent = intent_of(search_text(F.concat_ws(" ", "title", "prompt")))
    reply = F.to_json(F.struct(F.coalesce(hit["topic_id"], F.lit("")).alias("canonical_topic_id"), F.coalesce("title", F.lit("")).alias("canonical_label"), F.coalesce(intent, F.lit("")).alias("intent"), F.array(F.coalesce(intent, F.lit(""))).alias("subject"), F.when(hit.isNotNull(), 0.9).when(intent.isNotNull(), 0.6).otherwise(0.3).alias("confidence")))
    asked = questions.select("question_fingerprint", "source_id", "title", "prompt", "answer_labels", reply.alias("raw"))
    return parse_output(asked).withColumn("model", F.lit("rules")).withColumn("review_status", review_status(F.col("exclude_reason"), F.col("confidence")))


def first_questions(questions: DataFrame, limit: int) -> DataFrame:
    """The first `limit` questions in the order of their fingerprints, for a classifier that is asked for so many at most."""
    return questions.orderBy("question_fingerprint").limit(limit)


def upsert(index: DataFrame, records: DataFrame) -> DataFrame:
    """The index with new records in place of those with the same fingerprint, sorted."""
    rest = index.join(records.select("question_fingerprint").distinct(), "question_fingerprint", "left_anti")
    return records.unionByName(rest, allowMissingColumns=True).orderBy("question_fingerprint", "source_id")


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an index; a missing one is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path).drop("bucket")  # how it is stored is no part of a record
    except AnalysisException as failed:
        if failed.getCondition() != "PATH_NOT_FOUND":  # else an upsert could write an empty index over a good one
            raise
        return spark.createDataFrame([], schema)


def write_index(index: DataFrame, path: str, buckets: int = 16) -> None:
    """Write the index in hash buckets of the fingerprint; buckets of which `index` holds no record stay as they are."""
    spread = F.pmod(F.xxhash64("question_fingerprint"), F.lit(buckets)).cast("int")
    index.withColumn("bucket", spread).repartition("bucket").sortWithinPartitions("question_fingerprint").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_stored(path: str, records: DataFrame, buckets: int = 16) -> Version:
    """Put records into the index of a keyed store: only buckets of their fingerprints are read and written.

    Of records with one fingerprint the one that sorts first stays. Writers at the same time follow each other.
    """
    key = ["question_fingerprint"]
    rest = [c for c in records.columns if c not in key]
    once = records.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(records.columns)
    return merge_into_store(path, once, key, lambda old, new: new.unionByName(old.join(new.select(*key), key, "left_anti").select(new.columns)), buckets)
