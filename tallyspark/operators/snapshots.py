"""Snapshots of a source's rows by scope on files: written whole, named by a manifest, served fresh, refreshed or stale.

Below `root` lie `source=S/scope=C/data/<folder>` with rows and `source=S/scope=C/manifests/<time>-<id>` with the folder
and its number of rows, made after the rows are written. A snapshot counts if its manifest is complete and its files have
that many rows by their footers, so that a writer that is lost, and files that were deleted or cut, are passed over.
Source and scope are names without a slash; another layout of rows is another root.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, types as T

from .keyed_store import END, _names as names_below, place_of
from .polls import FRESH_SECONDS

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass(frozen=True)
class Snapshot:
    """When it was taken or last confirmed, the path of its rows, and their number."""

    taken: datetime
    path: str
    n_rows: int


@dataclass(frozen=True)
class Served:
    """Rows (None if there are none to serve), state (fresh, refreshed, stale or unavailable), and a warning."""

    rows: DataFrame | None
    state: str
    warning: str | None = None


def _scope(root: str, source: str, scope: str) -> str:
    return f"{root}/source={source}/scope={scope}"


def _confirm(spark: SparkSession, base: str, folder: str, n_rows: int, at: datetime) -> None:
    """Make a manifest; times of microseconds sort by name."""
    micros = (at - EPOCH) // timedelta(microseconds=1)
    fs, name = place_of(spark, f"{base}/manifests/{micros:020d}-{uuid.uuid4().hex}")
    out = fs.create(name, False)
    out.write(bytearray(f"{folder}\n{n_rows}\n{END}".encode()))
    out.close()


def write_snapshot(rows: DataFrame, root: str, source: str, scope: str, at: datetime) -> None:
    spark, base, folder = rows.sparkSession, _scope(root, source, scope), uuid.uuid4().hex
    rows.write.parquet(f"{base}/data/{folder}")
    _confirm(spark, base, folder, spark.read.schema(rows.schema).parquet(f"{base}/data/{folder}").count(), at)


def _read(spark: SparkSession, base: str, name: str, schema: T.StructType) -> Snapshot | None:
    """The snapshot of a manifest; None if either is damaged."""
    fs, at = place_of(spark, f"{base}/manifests/{name}")
    try:
        stream = fs.open(at)
        lines = bytes(stream.readAllBytes()).decode().splitlines()
        stream.close()
        if len(lines) != 3 or lines[2] != END:
            return None
        path = f"{base}/data/{lines[0]}"
        found = Snapshot(EPOCH + timedelta(microseconds=int(name.partition("-")[0])), path, int(lines[1]))
        return found if spark.read.schema(schema).parquet(path).count() == found.n_rows else None
    except Exception:  # noqa: BLE001 - whatever makes a snapshot unreadable, an older one may be read
        return None


def newest_readable(spark: SparkSession, root: str, source: str, scope: str, schema: T.StructType) -> Snapshot | None:
    """The newest snapshot that can be read; damaged ones are passed over."""
    base = _scope(root, source, scope)
    names = sorted((n for n in names_below(spark, f"{base}/manifests") if n.partition("-")[0].isdigit()), reverse=True)
    return next((found for name in names if (found := _read(spark, base, name, schema))), None)


def is_fresh(taken: datetime, now: datetime, seconds: int = FRESH_SECONDS) -> bool:
    """Of the last hour, or of the future."""
    return (now - taken).total_seconds() <= seconds


def serve(spark: SparkSession, root: str, source: str, scope: str, schema: T.StructType, load: Callable[[], DataFrame], now: datetime) -> Served:
    """Rows of a fresh snapshot; else those that `load` gives, which are kept; if it fails, those of the stale one, with a warning.

    A load fails when its frame is made, when a task reads its files, or when its columns are not those of the schema. A
    stale snapshot that was served counts as fresh again, so that a broken source is not asked at each call.
    """
    found = newest_readable(spark, root, source, scope, schema)
    rows = lambda s: spark.read.schema(schema).parquet(s.path)
    if found is not None and is_fresh(found.taken, now):
        return Served(rows(found), "fresh")
    try:
        write_snapshot(load().select(*schema.names), root, source, scope, now)
        return Served(rows(newest_readable(spark, root, source, scope, schema)), "refreshed")
    except Exception as failed:  # noqa: BLE001 - whatever a source raises, the others and the old rows are served
        reason = str(failed).splitlines()[0] if str(failed) else type(failed).__name__
    if found is None:
        return Served(None, "unavailable", f"{source} unavailable: {reason}")
    base = _scope(root, source, scope)
    _confirm(spark, base, found.path.rpartition("/")[2], found.n_rows, now)
    return Served(rows(found), "stale", f"{source} refresh failed; serving stale snapshot: {reason}")


def superseded(spark: SparkSession, root: str, source: str, scope: str, keep: int = 2) -> list[str]:
    """Manifests but the newest `keep`, and data folders that those do not name: what may be deleted when no reader is left."""
    base = _scope(root, source, scope)
    names = sorted(names_below(spark, f"{base}/manifests"), reverse=True)
    named = set()
    for name in names[:keep]:
        fs, at = place_of(spark, f"{base}/manifests/{name}")
        stream = fs.open(at)
        named.add(bytes(stream.readAllBytes()).decode().partition("\n")[0])
        stream.close()
    return [f"{base}/manifests/{n}" for n in names[keep:]] + [f"{base}/data/{f}" for f in sorted(names_below(spark, f"{base}/data")) if f not in named]
