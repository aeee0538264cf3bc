"""Texts that can't be decoded or parsed, and sources whose files fail inside a task, stop nothing."""

from tallyspark.operators import polls
from tallyspark.sources import charts, outcomes, pages

GOOD = b"Answer,All\nYes,1\nNo,2\n"


def test_bad_texts_beside_good_ones(spark):
    rows = [("a", GOOD), ("b", GOOD + b"\xff"), ("c", GOOD + b'"open'), ("d", b'x,y\n"a"b,1\n'), ("e", None), ("f", b""), ("g", b"one\n1"), ("h", "é,y\nü,1".encode())]
    done = outcomes.parse_outcomes(spark.createDataFrame(rows, "id string, content binary"), ["id"], "content", charts.parse_table_strictly, charts.TABLE)
    status = {r["id"]: r["status"] for r in done.collect()}
    assert status == {"a": "ok", "b": "failed", "c": "failed", "d": "failed", "e": "skipped", "f": "skipped", "g": "skipped", "h": "ok"}
    assert {r["id"]: r["headers"] for r in outcomes.parsed_rows(done, ["id"]).collect()} == {"a": ["Answer", "All"], "h": ["é", "y"]}
    reasons = {r["id"]: r["reason"] for r in outcomes.failed_texts(done, ["id"]).collect()}
    assert sorted(reasons) == ["b", "c", "d"] and reasons["b"] == f"undecodable text: byte {len(GOOD)}" and reasons["c"].startswith("Error: ")


def test_very_long_field(spark):
    """A field over the limit of the CSV module fails on its own."""
    rows = [("long", 'x,y\n"' + "a" * 200_000 + '",1'), ("good", GOOD.decode())]
    done = outcomes.parse_outcomes(spark.createDataFrame(rows, "id string, content string"), ["id"], "content", charts.parse_table_strictly, charts.TABLE)
    assert {r["id"]: r["status"] for r in done.collect()} == {"long": "failed", "good": "ok"}


def test_parser_that_raises(spark):
    def parse(html):
        if "bad" in html:
            raise RecursionError("too deep")
        return pages.parse_elements(html)

    df = spark.createDataFrame([(1, "<a href='/x'>y</a>"), (2, "bad"), (3, "no elements")], "id long, html string")
    done = outcomes.parse_outcomes(df, ["id"], "html", parse, "ordinal int, tag string, href string, text string, css string")
    assert [(r["id"], r["tag"], r["href"], r["text"]) for r in outcomes.parsed_rows(done, ["id"]).collect()] == [(1, "a", "/x", "y")]
    assert [(r["id"], r["reason"]) for r in outcomes.failed_texts(done, ["id"]).collect()] == [(2, "RecursionError: too deep")]
    empty = outcomes.parse_outcomes(df.limit(0), ["id"], "html", parse, "ordinal int, tag string, href string, text string, css string")
    assert empty.count() == 0


def test_file_that_fails_inside_a_task(spark, tmp_path):
    for name in ("good", "bad"):
        spark.createDataFrame([(1,), (2,)], "v int").coalesce(1).write.parquet(str(tmp_path / name))
    (data,) = (tmp_path / "bad").glob("*.parquet")
    data.write_bytes(data.read_bytes()[:30])
    for crc in (tmp_path / "bad").glob(".*.crc"):
        crc.unlink()
    load = lambda name: lambda: spark.read.schema("v int").parquet(str(tmp_path / name))
    rows, warnings = polls.load_sources(spark, {"bad": load("bad"), "good": load("good")}, written=True)
    assert [(r["source_id"], r["source_rank"], r["v"]) for r in rows.orderBy("v").collect()] == [("good", 0, 1), ("good", 0, 2)]
    assert [r["source_id"] for r in warnings.collect()] == ["bad"]
