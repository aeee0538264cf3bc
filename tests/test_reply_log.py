"""Replies are logged: repeated actions, failed batches and lost jobs ask nothing twice."""

import uuid
from pathlib import Path

import pytest

from tallyspark.operators import reply_log

SCHEMA = "question_fingerprint string, source_id string, title string, prompt string, answer_labels array<string>"


def questions(spark, names):
    return spark.createDataFrame([(f"f-{n}", "ipsos", n, None, ["1: yes"]) for n in names], SCHEMA)


def counting(folder, bad=(), lost=()):
    """A classifier that leaves a file for each question it replied to, and raises for batches that hold a bad one."""

    def classifier(rows):
        if set(rows["title"]) & set(bad):
            raise TimeoutError("no answer")
        for title in rows["title"]:
            Path(folder, f"{title}.{uuid.uuid4().hex}").touch()
        return [None if t in lost else f'{{"canonical_topic_id": "{t}", "confidence": 0.9}}' for t in rows["title"]]

    return classifier


def asked(folder):
    return sorted(p.name.partition(".")[0] for p in Path(folder).iterdir())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def test_each_question_once(spark, tmp_path, folder):
    names = [f"q{i:03d}" for i in range(250)]
    twice = questions(spark, names + names[:50])
    got = reply_log.classify_logged(twice, counting(folder), "m", f"{tmp_path}/log", batch=7, per_round=60)
    assert got.count() == 300 and {r["canonical_topic_id"] for r in got.collect()} == set(names)
    assert asked(folder) == names  # two actions on the records, and a fingerprint in two rows
    more = reply_log.classify_logged(questions(spark, names + ["new"]), counting(folder), "m", f"{tmp_path}/log")
    assert more.where("canonical_topic_id = 'new'").count() == 1 and asked(folder) == sorted([*names, "new"])
    assert reply_log.ask(questions(spark, names[:3]), counting(folder), "other", f"{tmp_path}/log") == 3


def test_failed_batches(spark, tmp_path, folder):
    names = [f"q{i:02d}" for i in range(40)]
    all_questions, log = questions(spark, names).coalesce(1), f"{tmp_path}/log"
    first = reply_log.classify_logged(all_questions, counting(folder, bad={"q07", "q23"}, lost={"q30"}), "m", log, batch=40)
    rest = set(names) - {"q07", "q23"}
    assert {r["canonical_topic_id"] for r in first.collect()} == rest - {"q30"} and set(asked(folder)) == rest
    failed = {r["question_fingerprint"]: (r["failures"], r["reason"], r["answered"]) for r in reply_log.failures(reply_log.read_log(spark, log), "m").collect()}
    assert failed == {"f-q07": (1, "TimeoutError: no answer", False), "f-q23": (1, "TimeoutError: no answer", False), "f-q30": (1, "no reply", False)}
    before = asked(folder)
    assert reply_log.ask(all_questions, counting(folder), "m", log) == 3
    assert sorted(set(before) | {"q07", "q23"}) == names and asked(folder) == sorted([*before, "q07", "q23", "q30"])
    assert reply_log.ask(all_questions, counting(folder), "m", log) == 0


def test_rounds_that_were_done_stay(spark, tmp_path, folder):
    """A job that dies in a later round keeps the replies of the earlier ones."""
    names, log = [f"q{i:02d}" for i in range(40)], f"{tmp_path}/log"
    reply_log.ask(questions(spark, names[:20]), counting(folder), "m", log)

    def dies(rows):
        raise SystemExit("lost")

    with pytest.raises(Exception):  # noqa: B017, PT011 - what Spark makes of a task that ends
        reply_log.ask(questions(spark, names), dies, "m", log)
    assert reply_log.ask(questions(spark, names), counting(folder), "m", log) == 20 and asked(folder) == names


def test_odd_input(spark, tmp_path, folder):
    none = spark.createDataFrame([], SCHEMA)
    assert reply_log.classify_logged(none, counting(folder), "m", f"{tmp_path}/log").count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), ("f", None, None, None, None)], SCHEMA)
    assert reply_log.ask(nulls, lambda rows: ["{}"] * len(rows), "m", f"{tmp_path}/log") == 1
