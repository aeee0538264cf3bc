"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and all but the last return the
columns of `documents`. Side tables (labels, benchmark) are read from sf_dir.

A null text counts as empty, and texts without words are copies of each other, of which one stays. Rows with one id and
unlike texts are different documents; of repeated rows and ties one stays, that with the smallest id. Very long texts
are worked on in blocks by the stages. Columns of `documents` keep their names and values, also those named like helper
columns, and settings of the session stay as they are; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm.bpe import bpe_round_trip
from tallyspark.llm.common import fresh_name, materialize, table
from tallyspark.llm.decontaminate import remove_contaminated
from tallyspark.llm.pii import find_personal_data, redact
from tallyspark.llm.quality_mil import score_quality, train_quality
from tallyspark.llm.queries import tokenizer_path
from tallyspark.llm.similar import keep_one_of_similar

#: Rows of an Arrow batch while near copies are searched for, as a row is a whole document.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier does not reject."""
    net = train_quality(docs, table(spark, sf_dir, "labels"))
    score, predicted = fresh_name(docs, "_score"), fresh_name(docs, "_predicted")
    return score_quality(docs, net, score_col=score, predicted_col=predicted).where(F.col(predicted) == 1).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, Jaccard 0.8), that with the smallest id.

    SimHash finds those within two bits; what it leaves apart is searched by min-hash bands. Both are checked exactly.
    """
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    try:  # all that uses Python is written in here
        return keep_one_of_similar(docs).select(docs.columns)
    finally:
        spark.conf.set(BATCH_SETTING, before)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without benchmark passages."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by their kinds; n_chars follows."""
    spans = fresh_name(docs, "_spans")
    found = find_personal_data(docs, out=spans)
    any_found = F.size(spans) > 0
    clean = found.withColumn("text", F.when(any_found, redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    clean = clean.withColumn("n_chars", F.when(any_found, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to the text again."""
    kept = ["doc_id", "lang", "source"]
    coded = bpe_round_trip(docs.select(*kept, "text"), tokenizer_path(), kept)
    return coded.select(*kept, "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("encode", encode),
]

#: A trained classifier and byte-pair merges can't be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
