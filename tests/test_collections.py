"""Structures of all kinds to observations."""

from tallyspark.operators.collections import STRUCTURES, map_collection


def structure(idx, kind, **own):
    row = dict.fromkeys("source_rank structure_idx source_id collection_title collection_subtitle type title prompt y_unit data x y slices series panels".split())
    return tuple((row | {"source_rank": 2, "structure_idx": idx, "source_id": "ipsos", "collection_title": "May", "collection_subtitle": "released 2026-05-02", "type": kind} | own).values())


def panel(columns, groups, *rows):
    return (columns, [(t, labels) for t, labels in groups], [(label, list(values)) for label, values in rows])


APPROVAL = "2026-04-28: Do you approve or disapprove of the job Donald Trump is doing as president?"


def test_all_kinds(spark):
    rows = [
        structure(0, "Crosstab", title="CP1. Main problem", prompt="What is the main problem facing the country?", panels=[panel(["Total", "Male"], [("Sex", ["Male"])], ("Crime", (3.0, 4.0)), ("Jobs", (5.0,)))]),
        structure(1, "BarGraph", title=APPROVAL, x=["Strongly approve", "Somewhat approve", "Unsure"], y=[20.0, 11.0]),
        structure(2, "PieChart", title=APPROVAL, slices=[("Approve", 31.0), (None, 1.0)]),
        structure(3, "LineGraph", title=APPROVAL, series=[("Approve", [1.0, 2.0]), ("Disapprove", [])]),
        structure(4, "Unstructured", data=f"{APPROVAL}\nand a text"),
        structure(5, "BarGraph", title="Weather", x=["Sunny"], y=[1.0]),  # one term only: neither topic nor candidate
        structure(6, "BarGraph", title=APPROVAL, x=[], y=[]),
        structure(7, "BarGraph", title="Support for tariffs on steel imports", x=["Yes"], y=[9.0]),
        structure(8, "BarGraph"),
    ]
    got = {r["structure_idx"]: r for r in map_collection(spark.createDataFrame(rows, STRUCTURES)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 7]
    assert [(got[k]["id"], got[k]["poll_date"]) for k in (0, 1)] == [("ipsos:important-problem:0", "2026-05-02"), ("ipsos:presidential-approval:1", "2026-04-28")]
    assert got[0]["question_title"] == "Main problem" and got[0]["source_collection"] == "May"
    values = {k: {(a["demographic_id"], a["answer_id"]): a["value"] for a in got[k]["answers"]} for k in got}
    assert values[0] == {("total", "issue-crime"): 3.0, ("total", "issue-jobs"): 5.0, ("gender-male", "issue-crime"): 4.0}
    assert values[1] == {("total", "approve"): 31.0} and values[2]["total", "approve"] == 31.0 and values[3] == {("total", "approve"): 2.0}
    assert got[7]["topic_id"].startswith("headline-candidate-") and "yes" in got[7]["answer_text"].lower()


def test_no_structures(spark):
    assert map_collection(spark.createDataFrame([], STRUCTURES)).count() == 0
