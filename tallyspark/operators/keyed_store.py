"""A table of keyed rows in hash buckets and versions: a batch reads and writes only the buckets of its own keys.

Below `path` lie `data/<folder>/bucket=K` with rows, and `versions/<number>` with the folder of each bucket, written last.
A version is committed by making its file, which fails if there is one: so of two writers one wins, and the other starts
again from the winner's version. Files of buckets that a batch does not touch are neither read nor written. A version
without its last line (its writer was lost) is passed over. Folders that no version names are left behind by lost
writers; `unused_folders` lists them. A version has one line a bucket, whatever the size of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64
END = "end"
Combine = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Version:
    """number (0 before the first), buckets of the table, and the folder of each bucket that has rows."""

    number: int
    buckets: int
    folders: dict[int, str]


def place_of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = place_of(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _read_version(spark: SparkSession, path: str, number: int) -> Version | None:
    fs, at = place_of(spark, f"{path}/versions/{number:012d}")
    stream = fs.open(at)
    try:
        lines = bytes(stream.readAllBytes()).decode().splitlines()
    finally:
        stream.close()
    if not lines or lines[-1] != END:
        return None
    buckets, folders = int(lines[0]), dict(line.split(" ", 1) for line in lines[1:-1])
    return Version(number, buckets, {int(k): v for k, v in folders.items()})


def newest_version(spark: SparkSession, path: str, before: int | None = None) -> Version | None:
    """The newest complete version (with a number below `before`), if there is one."""
    numbers = sorted((int(n) for n in _names(spark, f"{path}/versions") if n.isdigit()), reverse=True)
    for number in numbers:
        if before is None or number < before:
            found = _read_version(spark, path, number)
            if found is not None:
                return found
    return None


def _commit(spark: SparkSession, path: str, version: Version) -> bool:
    """Whether this writer made the version; False if there is one with its number."""
    fs, at = place_of(spark, f"{path}/versions/{version.number:012d}")
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception as failed:  # noqa: BLE001 - what the JVM raises
        if "FileAlreadyExists" in str(failed):
            return False
        raise
    text = "\n".join([str(version.buckets), *(f"{k} {v}" for k, v in sorted(version.folders.items())), END])
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_version(spark: SparkSession, path: str, schema: T.StructType, version: Version | None, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of a version, of the buckets in `only` if given; none without a version."""
    folders = [] if version is None else [f"{path}/data/{f}/bucket={k}" for k, f in version.folders.items() if only is None or k in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All rows of the newest version."""
    return read_version(spark, path, schema, newest_version(spark, path, before))


def bucket_of(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched_buckets(rows: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    return sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())


def merge_into_store(path: str, rows: DataFrame, keys: Sequence[str], combine: Combine, buckets: int = BUCKETS, number: int | None = None) -> Version:
    """Combine rows with those of the same buckets and commit the result as the next version.

    combine: from the old rows of the touched buckets and the new rows to the rows that take their place. number: of the
    version, for batches that may be repeated: a version that is there already is left as it is. A table keeps the
    number of buckets that it was made with.
    """
    spark = rows.sparkSession
    while True:
        base = newest_version(spark, path, number)
        if number is not None:
            done = newest_version(spark, path, number + 1)
            if done is not None and done.number == number:
                return done
        n = base.buckets if base else buckets
        touched = touched_buckets(rows, keys, n)
        merged = combine(read_version(spark, path, rows.schema, base, touched), rows).select(rows.columns)
        folder = f"{(base.number if base else 0) + 1 if number is None else number:012d}-{uuid.uuid4().hex}"
        merged.withColumn("bucket", bucket_of(keys, n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
        written = {int(name.partition("=")[2]) for name in _names(spark, f"{path}/data/{folder}") if name.startswith("bucket=")}
        kept = {k: v for k, v in (base.folders if base else {}).items() if k not in touched}
        version = Version(int(folder.partition("-")[0]), n, kept | dict.fromkeys(written, folder))
        if _commit(spark, path, version):
            return version
        fs, at = place_of(spark, f"{path}/data/{folder}")
        fs.delete(at, True)
        if number is not None and newest_version(spark, path, number + 1) == base:
            raise RuntimeError(f"version {number} of {path} was begun by a writer that is lost; delete its file")


def unused_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders that the newest version does not name; older versions may."""
    used = set((newest_version(spark, path) or Version(0, 0, {})).folders.values())
    return sorted(name for name in _names(spark, f"{path}/data") if name not in used)
