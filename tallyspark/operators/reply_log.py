"""Replies of a classifier in a log that is written before they are parsed: what was answered once is not asked again.

The log holds one row a call and question: fingerprint, model, the raw reply or the reason of a failure, and the time.
It lies in hash buckets of the fingerprint and is only appended to, so that a lost writer leaves either whole files or
none, and two writers at once cost a question asked twice, of which the first reply counts. Questions are asked in
rounds of so many at most, each a job of its own: what a lost driver loses is the round that it was in, and what a lost
executor loses are the replies of its unfinished tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import materialize
from .question_index import Classifier, parse_output, review_status

ASKED = ("question_fingerprint", "source_id", "title", "prompt", "answer_labels")
LOG = "question_fingerprint string, model string, raw string, failure string, asked_at timestamp"
BUCKETS, BATCH, TRIES, ROUND = 64, 100, 3, 1_000_000


def _bucket():
    return F.pmod(F.xxhash64("question_fingerprint"), F.lit(BUCKETS)).cast("int")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log, with their bucket; a missing log is empty."""
    schema = f"{LOG}, bucket int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as failed:
        if failed.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replies(log: DataFrame, model: str) -> DataFrame:
    """question_fingerprint and raw: the first reply of a model to each question."""
    answered = log.where((F.col("model") == model) & F.col("raw").isNotNull())
    return answered.groupBy("question_fingerprint").agg(F.min_by("raw", F.struct("asked_at", "raw")).alias("raw"))


def failures(log: DataFrame, model: str) -> DataFrame:
    """question_fingerprint, how often asking it failed, the reason of the last time, and whether it was answered since."""
    own = log.where(F.col("model") == model).groupBy("question_fingerprint")
    counted = own.agg(F.count("failure").alias("failures"), F.max_by("failure", F.when(F.col("failure").isNotNull(), F.col("asked_at"))).alias("reason"), F.max(F.col("raw").isNotNull()).alias("answered"))
    return counted.where("failures > 0")


def _answers(classifier: Classifier, rows: pd.DataFrame, tries: int, whole: bool = True) -> list[tuple[str | None, str | None]]:
    """Reply or reason for each row; a batch that fails for good is halved, so that one question does not cost the others their replies."""
    reason = ""
    for _ in range(tries if whole or len(rows) == 1 else 1):
        try:
            given = list(classifier(rows))
            if len(given) != len(rows):
                raise ValueError(f"{len(given)} replies to {len(rows)} questions")
            return [(None, "no reply") if pd.isna(raw) else (str(raw), None) for raw in given]
        except Exception as failed:  # noqa: BLE001 - whatever a classifier raises is a failure of its questions, not of the job
            reason = f"{type(failed).__name__}: {failed}"
    if len(rows) == 1:
        return [(None, reason)]
    half = len(rows) // 2
    return _answers(classifier, rows.iloc[:half], tries, False) + _answers(classifier, rows.iloc[half:], tries, False)


def ask(questions: DataFrame, classifier: Classifier, model: str, path: str, batch: int = BATCH, tries: int = TRIES, per_round: int = ROUND) -> int:
    """Ask for questions that the log has no reply of this model to, each fingerprint once; the number of those asked.

    classifier: from a batch of questions to one reply a row; it gets at most `batch` rows, and a batch again up to
    `tries` times when it raises. Failures are logged and asked again in the next call. Null fingerprints are not asked.
    """
    spark = questions.sparkSession
    rest = [c for c in ASKED if c != "question_fingerprint"]
    once = questions.where("question_fingerprint is not null").groupBy("question_fingerprint").agg(F.min(F.struct(*rest)).alias("_q")).select("question_fingerprint", "_q.*").withColumn("bucket", _bucket())
    known = replies(read_log(spark, path), model).select("question_fingerprint")
    pending = materialize(once.join(known, "question_fingerprint", "left_anti"), "pending-questions")
    n = pending.count()
    rounds = min(math.ceil(n / per_round), BUCKETS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for begin in range(0, len(rows), batch):
                part = rows.iloc[begin : begin + batch]
                given = _answers(classifier, part[list(ASKED)], tries)
                yield pd.DataFrame({"question_fingerprint": part["question_fingerprint"].to_list(), "model": model, "raw": [a for a, _ in given], "failure": [f for _, f in given], "asked_at": pd.Timestamp.now(tz="UTC"), "bucket": part["bucket"].to_list()})

    for k in range(rounds):
        own = pending.where(F.pmod("bucket", F.lit(rounds)) == k).repartition("bucket")
        own.mapInPandas(run, f"{LOG}, bucket int").write.mode("append").partitionBy("bucket").parquet(path)
    return n


def classify_logged(questions: DataFrame, classifier: Classifier, model: str, path: str, batch: int = BATCH, tries: int = TRIES, per_round: int = ROUND) -> DataFrame:
    """Records like those of `classify`, of all questions with a reply in the log after asking for what it lacks.

    Repeated actions on the result read the log and ask nothing.
    """
    ask(questions, classifier, model, path, batch, tries, per_round)
    answered = questions.select(*ASKED).join(replies(read_log(questions.sparkSession, path), model), "question_fingerprint")
    return parse_output(answered).withColumn("model", F.lit(model)).withColumn("review_status", review_status(F.col("exclude_reason"), F.col("confidence")))
