"""Questions with prompts and panels across page furniture, and ids of any type."""

from tallyspark.sources import charts, toplines

FIRST, SECOND = (t[0] for t in toplines.TEMPLATES)
TITLE, SAMPLE = "The Economist/YouGov Poll", "April 1 - 4, 2026 - 1,500 U.S. Adult Citizens"


def row(label, k):
    return " ".join([label, *(f"{i}%" for i in range(1, k + 1))])


def parsed(*lines):
    seen = {}
    for question, prompt, panel, r, label, *_ in toplines.parse_by_templates(list(lines)):
        seen.setdefault((question, prompt, panel), {})[r] = label
    return {key: [rows[r] for r in sorted(rows)] for key, rows in seen.items()}


def test_prompt_and_panels_over_furniture():
    lines = ["15. Support", "Do you support", "", "3", "the war?", FIRST, row("Yes", 12), "", "4", TITLE, SAMPLE, row("No", 12), "Totals 100% 100%", "Unweighted N (9) (4)", TITLE, SECOND, row("Yes", 11)]
    assert parsed(*lines) == {("15. Support", "Do you support the war?", 0): ["Yes", "No"], ("15. Support", "Do you support the war?", 1): ["Yes"]}


def test_far_panels_belong_to_the_question():
    far = [f"Methods, line {i}" for i in range(50)]
    assert parsed("1. A title", FIRST, row("Yes", 12), "Totals 1%", *far, SECOND, row("No", 11), "2. Another title", FIRST, row("Yes", 12)) == {
        ("1. A title", "", 0): ["Yes"], ("1. A title", "", 1): ["No"], ("2. Another title", "", 0): ["Yes"],
    }


def test_first_panel_within_nineteen_lines():
    for n, found in ((18, True), (19, False)):
        assert bool(parsed("1. A title", *["text"] * n, FIRST, row("Yes", 12))) is found


def test_titles_without_panels():
    assert parsed("1. A title", "text", "2A. Another title", "text", FIRST, row("Yes", 12)) == {("2A. Another title", "text", 0): ["Yes"]}
    assert parsed("1. A title", "2. Looks like a title", FIRST, row("Yes", 12)) == {("1. A title", "2. Looks like a title", 0): ["Yes"]}
    assert parsed("1. A title", TITLE, FIRST, row("Yes", 12)) == {}
    assert parsed("1. A title . . . . 3", FIRST, row("Yes", 12)) == {}
    assert parsed(*[f"{i}. A title" for i in range(3000)]) == {}


def test_rows_of_several_lines_and_of_other_lengths():
    assert parsed("1. A title", FIRST, "A label", "of two lines", row("that ends", 12), row("Short", 11)) == {("1. A title", "", 0): ["A label of two lines that ends"]}
    assert parsed("1. A title", FIRST, row("Too long", 13)) == {}


def test_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("a-1", "\n".join(["1. A title", FIRST, row("Yes", 12)])), ("b", None)], "doc_id string, text string")
    assert {r["doc_id"] for r in toplines.topline_cells(docs, "templates").collect()} == {"a-1"}
    tables = spark.createDataFrame([("c", "x,y\na,1\n"), ("d", None)], "chart_id string, csv string")
    assert [r["chart_id"] for r in charts.csv_cells(tables).collect()] == ["c"]


def test_a_row_is_handed_on_as_one(spark):
    """Each cell was a row of its own on its way from a worker; rows with their columns give the same cells, in both layouts."""
    text = "\n".join(["1. A title", FIRST, row("Yes", 12), "Or", row("no", 12), SECOND, row("Yes", 11)])
    other = "CP1. In your opinion, is it good?\nTotal\n(N=1,269)\nIndependent/Something\nelse (N=451)\nYes 40% *\nNo 60% 3\n"
    for layout, own, parse in (("templates", text, toplines.parse_by_templates), ("headers", other, toplines.parse_by_headers)):
        docs = spark.createDataFrame([(7, own), (8, None)], "doc_id long, text string")
        rows = toplines.topline_rows(docs, layout).collect()
        cells = [tuple(r) for r in toplines.topline_cells(docs, layout).collect()]
        assert sorted(cells, key=str) == sorted(((7, *c) for c in parse(own.split("\n"))), key=str) and len(cells) == sum(len(r["values"]) for r in rows)
        assert len(rows) == {"templates": 3, "headers": 2}[layout]
