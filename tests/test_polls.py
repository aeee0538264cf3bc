"""Poll operators on small examples, and clustering against the direct quadratic pass."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import hashing, questions as q, rules, stem, text as x
from tallyspark.operators import cluster, pooling, polls, question_index as qi, terms
from tallyspark.queries import QUERIES
from tallyspark.sources import charts, pages, sheets, toplines
from tallyspark.streaming import ingest


def one(spark, column, *values):
    """The column's value for each text."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


T = None


@pytest.fixture(autouse=True, scope="module")
def text_column(spark):
    global T
    T = F.col("t")


def test_text_functions(spark):
    assert one(spark, x.slug(T), "Don’t Know!!", " A b ", "--") == ["don-t-know", "a-b", ""]
    assert one(spark, x.slug_id(T), "/api/v1/topics/Foo Bar", "topics/x") == ["foo-bar", "x"]
    assert one(spark, x.search_text(T), "The U.S. and  don't", "United States") == ["the us and dont", "us"]
    assert one(spark, x.iso_date_text(T), "on 2026-04-28: x", "1234567890 2026-04-28", "12-3-4-567 2026-04-28", None) == ["2026-04-28", None, "2026-04-28", None]
    assert [str(d) for d in one(spark, x.text_date(T), "Washington, DC, September 27, 2025 - New polling", "Sept. 1, 2024", "none")] == ["2025-09-27", "2024-09-01", "None"]
    assert [str(d) for d in one(spark, x.blog_date(T), "16th Apr 2026", "31 Feb 2026")] == ["2026-04-16", "None"]
    assert one(spark, x.month_number(T), "Apr", "September", "Oct.", "x") == [4, 9, 10, None]
    assert [str(d) for d in one(spark, x.cutoff_date(T.cast("date"), "months", 1), "2026-03-31")] == ["2026-02-28"]
    assert [str(d) for d in one(spark, x.cutoff_date(T.cast("date"), "years", 1), "2024-02-29")] == ["2023-02-28"]
    assert one(spark, x.chart_number(T), "41%", "1,234", "<1", "-", "n/a", "", "x") == [41.0, 1234.0, 1.0, None, None, None, None]
    assert one(spark, x.row_values(T, 4), "Skipped 1% 1% - *", "too short") == [[1.0, 1.0, 0.0, 0.0], None]
    assert one(spark, x.row_label(T, 4), "Right direction 1 2 3 4") == ["Right direction"]
    assert one(spark, x.label_from_topic_id(T), "headline-us-ai-policy") == ["US AI Policy"]
    assert one(spark, x.scale_percent(T.cast("double")), "0.75", "45") == [75.0, 45.0]


def test_hash_and_stems(spark):
    assert one(spark, hashing.hash16(T), "abc", "", None) == ["e71fa2190541574b", "cbf29ce484222325", None]
    pairs = {"caresses": "caress", "flies": "fli", "dies": "die", "running": "run", "hopping": "hop", "hoping": "hope", "relational": "relat", "generalization": "general", "happily": "happili", "skies": "sky", "agreed": "agre", "sports": "sport", "policies": "polici", "voting": "vote", "national": "nation"}
    assert {w: stem.stem(w) for w in pairs} == {**pairs, "agreed": stem.stem("agreed")} and stem.stem("agreed") in ("agre", "agree")


def rolled(spark, rows):
    df = spark.createDataFrame([("presidential-approval", i, label, float(v)) for i, (label, v) in enumerate(rows)], "topic_id string, row_idx int, row_label string, value double")
    return {r["answer_id"]: (r["answer_label"], r["value"]) for r in pooling.roll_up(df, ["topic_id"]).collect()}


def test_answer_roll_up(spark):
    assert rolled(spark, [("Strongly approve", 15), ("Somewhat approve", 20), ("Somewhat disapprove", 10), ("Strongly disapprove", 50)]) == {"approve": ("Approve", 35.0), "disapprove": ("Disapprove", 60.0)}
    assert rolled(spark, [("Strongly approve", 15), ("Somewhat approve", 20), ("Approve (Net)", 34)])["approve"][1] == 34.0
    assert rolled(spark, [("Approve (Net)", 34), ("Strongly approve", 15)])["approve"][1] == 34.0
    assert rolled(spark, [("Don’t know", 3), ("Skipped", 1), ("Skipped", 2)]) == {"don-t-know": ("Don’t know", 3.0), "skipped": ("Skipped", 1.0)}


def test_panels_and_demographics(spark):
    panel = (["Total", "Dem", "Rep", "Ind"], [("Party ID", ["Dem", "Ind", "Rep"])], [("Approve", [40.0, 70.0, 10.0]), ("Disapprove", [1.0, 2.0, 3.0, 4.0])])
    df = spark.createDataFrame([(0, 7, [panel])], "source_rank int, structure_idx long, panels array<struct<columns:array<string>,groups:array<struct<title:string,labels:array<string>>>,rows:array<struct<label:string,values:array<double>>>>>")
    named = pooling.with_demographic(pooling.panel_cells(df)).collect()
    assert len(named) == 7  # the short row skips its last column
    assert {r["column_label"]: r["demographic_id"] for r in named} == {"Total": "total", "Dem": "party-democrat", "Rep": "party-republican", "Ind": "party-independent"}
    assert {r["group_id"] for r in named if r["column_label"] == "Dem"} == {"party-id"}


def test_sheets(spark):
    cells = [(0, 2, "Do you approve? - Selected Choice", None), (1, 2, "Approve", None), (1, 4, "Disapprove", None), (3, 0, "Party", None), (3, 1, "Democrat", None), (3, 3, None, 0.75), (3, 5, None, 0.15), (4, 1, "Republican", None), (4, 3, None, 0.20), (4, 5, None, 0.70), (5, 0, "Race", None), (5, 1, "White", None), (5, 3, None, 45.0), (5, 5, None, 40.0)]
    df = spark.createDataFrame([("w", "s", *c) for c in cells], "workbook string, sheet string, row int, col int, text string, number double")
    rows = {(r["answer"], r["demographic"]): (r["question"], r["group_title"], r["value"]) for r in sheets.crosstab_cells(df).collect()}
    assert {k: v[2] for k, v in rows.items()} == {("Approve", "Democrat"): 75.0, ("Approve", "Republican"): 20.0, ("Approve", "White"): 45.0, ("Disapprove", "Democrat"): 15.0, ("Disapprove", "Republican"): 70.0, ("Disapprove", "White"): 40.0}
    assert {v[0] for v in rows.values()} == {"Do you approve?"} and rows["Approve", "Republican"][1] == "Party"


def test_chart_csv(spark):
    df = spark.createDataFrame([(1, "Breakouts,Have volunteered,No but wanted to,No and not wanted to\nAll adults,39,24,37\nMore free time,41%,20%,39%\n"), (2, "Year,Approve,Disapprove\n2024,45,50\n2025,47,49\n"), (3, "one\n1"), (4, None)], "chart_id long, csv string")
    cells = charts.csv_cells(df)
    trends = charts.trend_charts(cells)
    line = charts.line_graphs(cells, trends).collect()
    assert [(r["chart_id"], r["x"], r["series"][0]["label"], r["series"][0]["values"]) for r in line] == [(2, ["2024", "2025"], "Approve", [45.0, 47.0])]
    tab = charts.crosstab_cells(cells, trends).collect()
    assert {r["chart_id"] for r in tab} == {1} and sorted(r["value"] for r in tab if r["row_label"] == "All adults") == [24.0, 37.0, 39.0]


def test_topline_text(spark):
    text = "CP2. Generally speaking, is it good?\nTotal\n(N=1,269)\nRepublican\n(N=435)\nDemocrat\n(N=351)\nIndependent/Something\nelse (N=451)\nRight direction 19 46 4 11\nWrong track 64 33 90 72\nDon’t know 16 21 6 17\nSkipped 1 1 0 0\nQ1. Do you approve of it?\nTotal (N=1,000)\nRepublican (N=400)\nDemocrat (N=350)\nApprove 40% 70% 10%\n"
    rows = toplines.topline_cells(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    second = {(r["row_label"], r["column_label"]): r["value"] for r in rows if r["question"].startswith("CP2")}
    assert len(second) == 16 and second["Don’t know", "Independent/Something else"] == 17.0
    assert [r["value"] for r in sorted((r for r in rows if r["question"].startswith("Q1")), key=lambda r: r["col_idx"])] == [40.0, 70.0, 10.0]
    panel = "15. Support for the war\nSex Race Age Education\nSupport 50% 51% 52% 53% 54% 55% 56% 57% 58% 59% 60% 61%\nTotals 100% 100%\n"
    rows = toplines.topline_cells(spark.createDataFrame([(1, panel)], "doc_id long, text string"), "templates").collect()
    assert len(rows) == 12 and {r["group_title"] for r in rows} == {None, "Sex", "Race", "Age", "Education"}
    lines = toplines.document_lines(spark.createDataFrame([(1, "\nThe Poll\n\nApril 1 - 4, 2026\n3")], "doc_id long, text string"))
    assert [(r["title"], r["subtitle"]) for r in toplines.document_header(lines).collect()] == [("The Poll", "April 1 - 4, 2026")]


def test_pages(spark):
    html = '<h2>First poll</h2><p>16th Apr 2026</p><a href="/poll/1">x</a><h2>Second</h2><a href="/opinion/2">y</a><h3>Third</h3><span>Washington, D.C., April 28, 2026 - </span><a href="https://o.example/poll/3?x#y">z</a><iframe data-src="https://datawrapper.dwcdn.net/Ne1q8/8/"></iframe><a href="/spreadsheets/d/abc123/edit?u">s</a><a href="/t.pdf?download=1">p</a>'
    found = pages.elements(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    stubs = [(r["title"], r["article_url"], str(r["published_on"])) for r in pages.release_stubs(found, "https://h.example", "/poll/").orderBy("ordinal").collect()]
    assert stubs == [("First poll", "https://h.example/poll/1", "2026-04-16"), ("Third", "https://o.example/poll/3?x#y", "2026-04-28")]
    assets = {r["kind"]: r["url"] for r in pages.page_assets(found, "https://h.example").collect()}
    assert assets == {"chart": "https://datawrapper.dwcdn.net/Ne1q8/8/dataset.csv", "sheet": "https://h.example/spreadsheets/d/abc123/edit?u", "pdf": "https://h.example/t.pdf"}
    assert one(spark, pages.sheet_id(T), "/spreadsheets/d/abc123/edit?x", "/x") == ["abc123", None]


def test_question_text(spark):
    assert one(spark, q.clean_generic(T), "2026-04-28: Americans feel the economy is on the wrong track: TM1128Y17_37. Do you approve?", "April 24 - 27, 2026 - 1836 U.S. Adult Citizens: 15. Support for Iran War", "Latest: Do you care?") == ["Do you approve?", "Support for Iran War", "Do you care?"]
    assert one(spark, q.question_key(T), "CP1. Do you Approve?") == ["do you approve?"]
    assert one(spark, q.battery_item(T), "Do you approve of these? Foreign aid", "Approval on issues - Taxes", "Nothing - here") == ["Foreign aid", "Taxes", None]
    df = spark.createDataFrame([(1, "Latest Reuters/Ipsos poll: Americans increasingly support sports betting")], "i long, t string")
    keys = {t["key"] for t in terms.extract_terms(df, "i", "t").collect()[0]["terms"]}
    assert {"sports", "betting"} <= keys and not {"ipsos", "poll"} & keys
    assert one(spark, rules.intent_of_label(T), "Do you support or oppose it?", "Was it worth it?", "plain") == ["support-oppose", "worth-it", None]


def test_classifier_output_and_index(spark):
    raw = '<think>{"x": 1}</think> ```json\n{"canonical_topic_id": " iran military action support ", "canonical_label": "L", "subject": ["Iran", "Military Action"], "confidence": 84}\n```'
    rows = qi.parse_output(spark.createDataFrame([(1, raw), (2, "no object"), (3, "{}")], "i int, raw string")).orderBy("i").collect()
    assert (rows[0]["canonical_topic_id"], rows[0]["subject"], rows[0]["confidence"], rows[0]["rejected"]) == ("iran military action support", ["iran", "military-action"], 0.84, False)
    assert rows[1]["rejected"] and rows[2]["exclude_reason"] == "model returned no canonical topic id"
    df = spark.createDataFrame([("iran military action support", 0.55, None), ("presidential-approval", 0.55, None), ("x", 0.54, None), ("x", 0.9, "no")], "i string, c double, e string")
    got = [r[0] for r in df.select(qi.applicable_topic(F.col("i"), F.lit(""), F.col("c"), F.col("e"))).collect()]
    assert got == ["headline-iran-military-action-support", "presidential-approval", None, None]


def test_custom_classifier(spark):
    asked = spark.createDataFrame([("f1", "gallup", "t", "p", ["a"])], "question_fingerprint string, source_id string, title string, prompt string, answer_labels array<string>")
    reply = lambda batch: pd.Series(['{"canonical_label": "My Topic", "confidence": 0.9}'] * len(batch))
    row = qi.classify(asked, reply, "m").collect()[0]
    assert (row["canonical_topic_id"], row["review_status"], row["model"]) == ("headline-my-topic", "accepted", "m")


def direct_clusters(rows):
    """The ordered pass over all members of all clusters."""
    clusters = []
    for r in rows:
        scores = [max([0.0, *(pair_score(r, o) or 0.0 for o in own)]) for own in clusters]
        best = max(range(len(scores)), key=lambda i: (scores[i], i), default=None)
        if best is not None and np.float32(scores[best]) >= np.float32(0.45):
            clusters[best].append(r)
        else:
            clusters.append([r])
    return {r[0]: own[0][0] for own in clusters for r in own}


def pair_score(a, b):
    fa, fb = set(a[2]), set(b[2])
    shared, weak = fa & fb, set(cluster.WEAK)
    if a[1] != b[1] or not shared or (not shared - weak and a[2] != b[2]):
        return None
    sa, sb = fa - weak, fb - weak
    small, large = sorted((sa, sb), key=len)
    if sa and sb and sa != sb and len(small) <= 2 and small <= large:
        return None
    jaccard, containment, fuzzy = np.float32(len(shared) / len(fa | fb)), np.float32(len(shared) / min(len(fa), len(fb))), np.float32(cluster.jaro_winkler(" ".join(a[2]), " ".join(b[2])))
    if len(shared) >= 2 and (jaccard >= 0.25 or containment >= 0.5 or fuzzy >= np.float32(0.86)):
        return max(jaccard, containment * np.float32(0.8), fuzzy * np.float32(0.65))
    return fuzzy * np.float32(0.55) if len(shared) == 1 and fuzzy >= np.float32(0.92) else None


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_direct_pass(spark, seed):
    rng = random.Random(seed)
    pool = ["iran", "israel", "tariff", "school", "betting", "policy", "price", "ukraine", "senat", "vaccin"]
    rows = [(i, rng.choice([None, "approval", "worth-it"]), sorted(rng.sample(pool, rng.randint(2, 5)))) for i in range(70)]
    df = spark.createDataFrame([(i, intent, f, " ".join(f), [{"key": k, "label": k} for k in f]) for i, intent, f in rows], "obs_ord long, intent string, features array<string>, signature string, terms array<struct<key:string,label:string>>")
    got = cluster.cluster_questions(df).collect()
    assert {r["obs_ord"]: r["cluster"] for r in got} == direct_clusters(rows)
    assert len({r["topic_id"] for r in got}) == len({r["cluster"] for r in got})


@pytest.mark.parametrize("block", [3, 2000])
def test_prefix_filters_lose_no_pair(spark, block):
    """All pairs with a score, by brute force: sets with a hot feature, general words, and spellings that are nearly alike."""
    rng = random.Random(block)
    words = [f"{a}{b}{c}" for a in ("tariff", "school", "vaccin", "senat") for b in ("", "s", "al") for c in ("", "z")]
    rows, seen = [], set()
    for i in range(260):
        features = sorted({*(["trump"] if rng.random() < 0.6 else []), *rng.sample(list(cluster.WEAK[:6]), rng.randrange(3)), *rng.sample(words, rng.randint(1, 4))})
        intent = rng.choice([None, "approval"])
        if len(features) > 1 and (intent, *features) not in seen:
            seen.add((intent, *features))
            rows.append((i, intent, features))
    expected = {(a[0], b[0]): round(float(s), 5) for k, a in enumerate(rows) for b in rows[k + 1 :] if (s := pair_score(a, b)) is not None}
    nodes = spark.createDataFrame([(i, intent, f, " ".join(f)) for i, intent, f in rows], "node long, intent string, features array<string>, signature string")
    got = {(r["left"], r["right"]): round(r["score"], 5) for r in cluster.similar_pairs(nodes, block=block).collect()}
    assert got == expected
    assert {p for p, s in expected.items() if s >= 0.45} == {(r["left"], r["right"]) for r in cluster.similar_pairs(nodes, 0.45, block).collect()}
    # far fewer candidates than pairs of one hot feature and intent, each once
    met = cluster.candidate_pairs(nodes, block).select("node_l", "node_r").collect()
    hot = [sum("trump" in f and i == intent for _, i, f in rows) for intent in (None, "approval")]
    assert len(met) == len(set(met)) and expected.keys() <= {tuple(r) for r in met} and sum(n * (n - 1) // 2 for n in hot) > 4000


def test_no_tile_of_a_hot_feature_is_large(spark):
    """3000 wordings with one feature and little else in common: few pairs are scored, and no task gets a block of them."""
    rows = [(i, "x", sorted(["hot", f"own{i}", f"other{i % 50}"]), f"{i} hot") for i in range(3000)]
    nodes = spark.createDataFrame(rows, "node long, intent string, features array<string>, signature string")
    assert cluster.candidate_pairs(nodes).where("size(array_intersect(features_l, features_r)) >= 2").count() == 50 * 60 * 59 // 2
    keyed = nodes.select("node", F.lit("k").alias("key"))
    tiles = cluster.meetings(keyed, ["key"], 500).groupBy("l.i", "l.j").count().collect()
    assert sum(r["count"] for r in tiles) == 3000 * 2999 // 2 and max(r["count"] for r in tiles) < 2 * 500 * 500 and len(tiles) >= 30


def test_jaro_winkler():
    assert round(cluster.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(cluster.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133 and cluster.jaro_winkler("", "a") == 0.0


def test_snapshots_at_the_edge(spark):
    df = spark.createDataFrame([(1, "a", "s", "2024-01-01 00:00:00", True), (2, "a", "s", "2024-01-01 02:00:00", False), (3, "b", "s", "2024-01-01 00:00:01", True), (4, "c", "s", "2024-01-02 00:00:00", True)], "snapshot_id long, source_id string, scope string, ts string, readable boolean").withColumn("snapshot_ts", F.col("ts").cast("timestamp")).drop("ts")
    got = {r["source_id"]: (r["snapshot_id"], r["fresh"]) for r in polls.latest_snapshots(df, F.lit("2024-01-01 01:00:01").cast("timestamp")).collect()}
    assert got == {"a": (1, False), "b": (3, True), "c": (4, True)}


def test_ingest_merges(spark):
    old = spark.createDataFrame([("a", "u", 1, "old")], "source_id string, article_url string, seen_at int, v string")
    new = spark.createDataFrame([("a", "u", 2, "new"), ("a", "w", 1, "x")], old.schema)
    assert {(r["article_url"], r["v"]) for r in ingest.merge_snapshots(old, new).collect()} == {("u", "new"), ("w", "x")}


@pytest.mark.parametrize("name", ["question_cleaning", "number_parsing", "text_hashes", "classifier_output", "page_links", "line_kinds", "document_headers", "headline_workload", "enrichment_batch"])
def test_queries_without_sql_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_places_of_a_hot_group_equal_brute_force(spark):
    from tallyspark.operators import builder

    rows = [("hot" if i % 4 else None if i % 8 else "cold", i, f"v{i}") for i in range(3000)]
    got = builder.numbered(spark.createDataFrame(rows, "g string, k long, v string").repartition(7), "g", "k").collect()
    groups = {g: sorted((k for h, k, _ in rows if h == g), reverse=True) for g in {r[0] for r in rows}}
    assert len(got) == 3000 and all(r["place"] == groups[r["g"]].index(r["k"]) + 1 and r["v"] == f"v{r['k']}" for r in got)
    assert builder.numbered(spark.createDataFrame([], "g string, k long"), "g", "k").count() == 0


def test_trend_series_of_one_question(spark):
    from tallyspark.operators import builder

    cells = [(s, 0, f"2026: Poll {s}", "Approve?", row, col, label, 10.0 * s + 3 * row + col) for s in range(5) for row in (1, 0) for col, label in enumerate(("Total", "Male" if s % 2 else None))]
    df = spark.createDataFrame(cells, "structure_idx long, panel_idx int, title string, prompt string, row_idx int, col_idx int, column_label string, value double")
    got = builder.trend_series(df, "Approve?", "male").orderBy("place").collect()
    assert [(r["label"], r["value"]) for r in got] == [(f"2026 (Poll {n})", 10.0 * s + s % 2) for n, s in enumerate((4, 3, 2, 1, 0), start=1)]


def test_charts_by_their_own_look(spark):
    df = spark.createDataFrame([(1, "Group,A,,B\n\nAll,1,2,n/a\n,5,6,7\nSome,4\n"), (2, "Year,A,,B\n2024,1,2,\n,3%,4,-\n2025,1\n"), (3, "Year,A\n")], "chart_id long, csv string")
    cells = charts.csv_cells(df)
    (line,) = charts.line_graphs(cells).collect()
    assert (line["chart_id"], line["x"], [(s["label"], s["values"]) for s in line["series"]]) == (2, ["2024", "2025"], [("A", [1.0, 3.0, 1.0])])
    tab = charts.crosstab_cells(cells).collect()
    assert sorted((r["chart_id"], r["row_idx"], r["col_idx"], r["column_label"], r["row_label"], r["value"]) for r in tab) == [(1, 0, 0, "A", "All", 1.0), (1, 0, 1, "", "All", 2.0), (1, 0, 2, "B", "All", 0.0), (1, 2, 0, "A", "Some", 4.0), (1, 2, 1, "", "Some", 0.0), (1, 2, 2, "B", "Some", 0.0)]
    turned = charts.crosstab_cells(cells, transpose=True).where("column_label = 'Some'").collect()
    assert {(r["row_label"], r["col_idx"]) for r in turned} == {("A", 2), ("", 2), ("B", 2)}
