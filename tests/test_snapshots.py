"""Snapshots of sources: what is served when files or refreshes fail."""

from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest

from tallyspark.operators import snapshots

NOW = datetime(2026, 5, 1, 12, tzinfo=UTC)


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def served(spark, root, load, now=NOW, schema=None):
    got = snapshots.serve(spark, root, "s", "all", schema or frame(spark).schema, load, now)
    return got.state, None if got.rows is None else sorted(r["v"] for r in got.rows.collect()), got.warning


def fails():
    raise ConnectionError("no route\nto the source")


def test_states(spark, tmp_path):
    root = str(tmp_path)
    assert served(spark, root, fails) == ("unavailable", None, "s unavailable: no route")
    assert served(spark, root, lambda: frame(spark, 1)) == ("refreshed", [1], None)
    assert served(spark, root, fails, NOW + timedelta(hours=1)) == ("fresh", [1], None)  # exactly an hour old
    late = NOW + timedelta(hours=1, microseconds=1)
    assert served(spark, root, fails, late) == ("stale", [1], "s refresh failed; serving stale snapshot: no route")
    assert served(spark, root, fails, late + timedelta(minutes=59)) == ("fresh", [1], None)
    assert served(spark, root, lambda: frame(spark, 2, 3), late + timedelta(hours=2)) == ("refreshed", [2, 3], None)
    assert len(list((tmp_path / "source=s/scope=all/data").iterdir())) == 2  # a stale one is confirmed, not copied
    assert snapshots.newest_readable(spark, root, "s", "other", frame(spark).schema) is None


def test_failures_inside_tasks_and_wrong_columns(spark, tmp_path):
    root, bad = str(tmp_path / "root"), tmp_path / "bad"
    snapshots.write_snapshot(frame(spark, 1), root, "s", "all", NOW - timedelta(hours=3))
    frame(spark, 7).coalesce(1).write.parquet(str(bad))
    (data,) = bad.glob("*.parquet")
    data.write_bytes(data.read_bytes()[:40])
    for crc in bad.glob(".*.crc"):
        crc.unlink()
    state, rows, warning = served(spark, root, lambda: spark.read.schema("v int").parquet(str(bad)))
    assert (state, rows) == ("stale", [1]) and warning.startswith("s refresh failed")
    assert served(spark, root, lambda: spark.range(3), NOW + timedelta(hours=2))[:2] == ("stale", [1])


@pytest.mark.parametrize("damage", ["manifest", "empty manifest", "file", "cut file"])
def test_damaged_ones_are_passed_over(spark, tmp_path, damage):
    root = str(tmp_path)
    snapshots.write_snapshot(frame(spark, 1), root, "s", "all", NOW - timedelta(minutes=20))
    snapshots.write_snapshot(frame(spark, 2).coalesce(1), root, "s", "all", NOW - timedelta(minutes=10))
    newest = Path(snapshots.newest_readable(spark, root, "s", "all", frame(spark).schema).path)
    manifest = max((tmp_path / "source=s/scope=all/manifests").glob("[0-9]*"))
    (data,) = newest.glob("*.parquet")
    for crc in (*newest.glob(".*.crc"), *manifest.parent.glob(".*.crc")):
        crc.unlink()
    if damage == "file":
        data.unlink()
    elif damage == "cut file":
        data.write_bytes(data.read_bytes()[:-20])
    else:
        manifest.write_text(manifest.read_text().replace("\nend", "") if damage == "manifest" else "")
    assert served(spark, root, fails) == ("fresh", [1], None)


def test_empty_sources_and_superseded(spark, tmp_path):
    root = str(tmp_path)
    for k in range(4):
        snapshots.write_snapshot(frame(spark, *range(k)), root, "s", "all", NOW + timedelta(minutes=k))
    assert served(spark, root, fails)[:2] == ("fresh", [0, 1, 2])
    old = snapshots.superseded(spark, root, "s", "all", keep=1)
    assert len(old) == 6 and snapshots.newest_readable(spark, root, "s", "all", frame(spark).schema).path not in old
    snapshots.write_snapshot(frame(spark), root, "e", "all", NOW)
    assert snapshots.newest_readable(spark, root, "e", "all", frame(spark).schema).n_rows == 0
