"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Each record draws a number in (0, 1) for every shard from the hash of its key and the shard's number; the shard with
the highest -weight / ln(number) wins, ties going to the lower shard. A record's shard depends on its key and the
weights alone, so that another shard only takes records into itself, its share of them.

Slots number the rows of a shard from 0 without gaps. Each shard is cut into buckets by a hash that also takes the
row's place in the input, so that neither a shard nor a key with very many rows lands in one task; rows are numbered in
their bucket, and a bucket starts where those before it end. Buckets are written before they are counted, so that
counts and numbers agree if an executor is lost.

Defined results: a null key counts as the empty key; a null text has size 16 and checksum 0; rows with equal keys share
a shard and have slots of their own; columns named like an output column are replaced; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

#: Rows of a bucket, about, in which rows are numbered together.
BUCKET_ROWS = 50_000
MIN_BUCKETS = 32


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) of a key and a shard."""
    return (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) that wins a key."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    drawn = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, i: F.struct((-w / F.log(draw(key, i))).alias("score"), (-i).alias("minus")))
    return (-F.array_max(drawn)["minus"]).cast("int")


def number_rows(df: DataFrame, group_col: str, order_cols: Sequence[str], out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps; equal rows are numbered in any order."""
    groups = max(1, df.select(group_col).distinct().count())
    rows = df.count()
    buckets = max(MIN_BUCKETS, -(-rows // (groups * BUCKET_ROWS)))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in order_cols], F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    placed = materialize(df.withColumn("_bucket", spread), "bucketed")
    counts = placed.groupBy(group_col, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(group_col, "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    within = Window.partitionBy(group_col, "_bucket").orderBy(*order_cols)
    numbered = placed.withColumn("_nth", F.row_number().over(within) - 1)
    return numbered.join(starts, [group_col, "_bucket"]).withColumn(out, (F.col("_nth") + F.col("_start")).cast("long")).drop("_bucket", "_nth", "_start")


def shard_records(df: DataFrame, weights: Sequence[float], added: Sequence[float] = (1.0,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and the shard with further shards of the weights `added`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = df.select(
        F.col(id_col),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(id_col), weights).alias("shard"),
        rendezvous_shard(F.col(id_col), [*weights, *added]).alias("grown_shard"),
    )
    return number_rows(materialize(placed, "placed"), "shard", [id_col, "text_crc32", "size"])


def write_shards(df: DataFrame, weights: Sequence[float], path: str, id_col: str = "doc_id", rows_per_file: int = 100_000) -> None:
    """Write whole rows to one folder a shard, in files of bounded length."""
    placed = df.withColumn("shard", rendezvous_shard(F.col(id_col), weights))
    spread = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(MIN_BUCKETS))
    placed.repartition(F.col("shard"), spread).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
