"""Polls: scopes, repeated releases, accounting, overviews, and the snapshot store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import ascii_lower, cutoff_date
from ..shared import materialize

FRESH_SECONDS = 3600


def in_scope(df: DataFrame, unit: str, n: int, today: Column, date_col: str = "published_on") -> DataFrame:
    """Rows from the first day of the scope on."""
    return df.where(F.col(date_col) >= cutoff_date(today, unit, n))


def latest_entries(df: DataFrame, n: int, key: str = "source_id", order: tuple[str, ...] = ("poll_key",)) -> DataFrame:
    """The n newest rows of each source, with their place; run it on the narrow poll list, and join other tables to it."""
    newest = Window.partitionBy(key).orderBy(F.col("published_on").desc(), *order)
    return df.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def first_release(df: DataFrame, key: tuple[str, ...] = ("source_id", "article_url"), order: tuple[str, ...] = ("poll_key",)) -> DataFrame:
    """One row per source and URL, the first in listing order; by an aggregate, which sums up before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("copies"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest], "copies")


def ingest_account(df: DataFrame, samples: int = 3) -> DataFrame:
    """Per source: candidates, failures, skipped, structures, first failures, and whether all failed.

    df: source_id, ord, status ('ok', 'failed', 'skipped'), detail.
    """
    failed = df.where("status = 'failed'")
    place = Window.partitionBy("source_id").orderBy("ord")
    first = failed.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= samples).groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "detail"))), lambda x: x["detail"]).alias("failure_samples"))
    counted = df.groupBy("source_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "ok").alias("structures"))
    return counted.join(first, "source_id", "left").withColumn("all_failed", (F.col("candidates") > 0) & (F.col("failures") == F.col("candidates")))


def retain_matches(df: DataFrame, question: str) -> DataFrame:
    """Structures whose title, prompt or text holds the wording, without regard to ASCII case."""
    return df.where(ascii_lower(F.concat_ws(" ", "title", "prompt")).contains(question.lower()))


def collection_subtitle(df: DataFrame, scope_label: str) -> DataFrame:
    """Per source: "{scope} collection: {last} to {first} ({n} articles)" over its list, newest first."""
    summed = df.groupBy("source_id").agg(F.min("published_on").alias("last"), F.max("published_on").alias("first"), F.count("*").alias("n"))
    text = F.format_string(f"{scope_label} collection: %s to %s (%d articles)", F.col("last").cast("string"), F.col("first").cast("string"), F.col("n"))
    return summed.select("source_id", text.alias("subtitle"))


def source_overview(sources: DataFrame, structures: DataFrame) -> DataFrame:
    """Per source: status, number of structures and graphs, and a summary text; sources without structures are unavailable."""
    counted = structures.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") != "Unstructured").alias("g"))
    joined = sources.join(counted, "source_id", "left")
    n, g = F.coalesce("n", F.lit(0)), F.coalesce("g", F.lit(0))
    text = F.concat(n.cast("string"), F.when(n == 1, " structure, ").otherwise(" structures, "), g.cast("string"), F.when(g == 1, " graph").otherwise(" graphs"))
    return joined.select("source_id", F.when(F.col("n").isNull(), "Unavailable").otherwise("Synced").alias("status"), n.alias("structures"), g.alias("graphs"), text.alias("summary"))


def latest_snapshots(df: DataFrame, now: Column) -> DataFrame:
    """Per source and scope: the newest readable snapshot, and whether it is still fresh (a future one is)."""
    newest = df.where("readable").groupBy("source_id", "scope").agg(F.max(F.struct("snapshot_ts", "snapshot_id")).alias("_s"), F.count("*").alias("readable_count"))
    age = F.unix_micros(now) - F.unix_micros("_s.snapshot_ts")
    return newest.select("source_id", "scope", F.col("_s.snapshot_id").alias("snapshot_id"), F.col("_s.snapshot_ts").alias("snapshot_ts"), "readable_count", (age <= FRESH_SECONDS * 1_000_000).alias("fresh"))


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources' rows with their names and ranks, in the order given."""
    out = None
    for rank, (name, df) in enumerate(frames.items()):
        own = df.withColumns({"source_id": F.lit(name), "source_rank": F.lit(rank)})
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no sources")
    return out


def load_sources(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]], written: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """All rows of the sources that can be read (None if none can), and source_id and warning of those that can't.

    A loader fails when it is called: a missing path or table shows as soon as its frame is made. With `written` each
    source is read and written on its own, so that one whose files fail inside a task is a warning as well.
    """
    frames, warnings = {}, []
    for name, load in loaders.items():
        try:
            frames[name] = materialize(load(), f"source-{name}") if written else load()
        except Exception as failed:  # noqa: BLE001 - whatever a source raises makes it unavailable, not the others
            warnings.append((name, f"{name} unavailable: {str(failed).splitlines()[0]}"))
    return (union_sources(frames) if frames else None), spark.createDataFrame(warnings, "source_id string, warning string")
