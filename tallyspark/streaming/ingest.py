"""Incremental ingest of releases: new URLs are appended once, and the newest snapshot of each key is kept.

Both go by a keyed store: a batch reads the buckets of its own URLs only, however much was stored before, and a repeated
batch finds its version there and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed_store import BUCKETS, merge_into_store, newest_version, read_version, touched_buckets

KEYS = ("source_id", "article_url")


def new_releases(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Releases (source_id, article_url, seen_at, ...) not seen within the watermark's delay; that bounds the state."""
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["source_id", "article_url"])


def merge_snapshots(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The newest row of each source and URL of both; of equally new ones that with the largest values."""
    both = new if old is None else old.unionByName(new)
    rest = [c for c in both.columns if c not in KEYS]
    newest = both.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("seen_at", *rest)).alias("_r"))
    return newest.select(*KEYS, *[F.col(f"_r.{c}").alias(c) for c in rest])


def start_ingest(stream: DataFrame, path: str, checkpoint: str, delay: str = "7 days", buckets: int = BUCKETS) -> StreamingQuery:
    """Append each new release below `path`, in a folder per batch that a repeated batch writes over.

    The watermark forgets old releases, so each batch is also compared with the URLs of its buckets in the store below
    `checkpoint`/urls.
    """
    store = f"{checkpoint}/urls"

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            urls = batch.select(*KEYS).distinct()
            before = newest_version(batch.sparkSession, store, number + 1)
            if before is not None:
                old = read_version(batch.sparkSession, store, urls.schema, before, touched_buckets(urls, KEYS, before.buckets))
                fresh = batch.join(old, list(KEYS), "left_anti").select(batch.columns)
            else:
                fresh = batch
            fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
            merge_into_store(store, urls, KEYS, lambda old, new: old.unionByName(new).distinct(), buckets, number + 1)
        finally:
            batch.unpersist()

    return new_releases(stream, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_snapshots(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the newest row of each source and URL in the store at `path`, also when rows come late or again."""

    def write(batch: DataFrame, number: int) -> None:
        merge_into_store(path, merge_snapshots(None, batch), KEYS, merge_snapshots, buckets, number + 1)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
