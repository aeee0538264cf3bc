"""Topline furniture and wordings, cluster ids and labels."""

from pyspark.sql import functions as F

from tallyspark.functions.hashing import hash8
from tallyspark.operators import cluster, terms
from tallyspark.sources import toplines


def test_noise_is_fixed_lines_only(spark):
    lines = ["Public affairs matter 41%", "WASHINGTON DC 20006", "contact:", "Contact: us", "12345", "TOPLINE & METHODOLOGY  Annotated Questionnaire", "Page 2 of 9", "Q1. Is it good?"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    kinds = {r["doc_id"]: r["kind"] for r in toplines.document_lines(df).select("doc_id", toplines.line_kind(F.col("line")).alias("kind")).collect()}
    assert [kinds[i] for i in range(8)] == ["row", "noise", "noise", "text", "noise", "blank", "page", "question"]


def test_wording_of_several_lines(spark):
    text = "CP2. Generally speaking, would you say things\nin this country are going\n7\nAnnotated Questionnaire\nthe right way?\nTotal\n(N=1,269)\nRepublican\n(N=435)\nPublic affairs matter 41 30\nWashington DC 20006\nNo 59 70\n"
    rows = toplines.topline_cells(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r["question"] for r in rows} == {"CP2. Generally speaking, would you say things in this country are going the right way?"}
    assert {r["row_label"] for r in rows} == {"Public affairs matter", "No"} and {r["group_title"] for r in rows} == {"Respondents"}


def test_ids_of_clusters_with_one_label(spark):
    df = spark.createDataFrame([(1, "Iran War", "k1|"), (2, "Iran War", "k2|"), (3, "Iran War", "k3|"), (4, "Iran War", "k3|"), (5, "Iran War", "k3|"), (6, "È", "k4|")], "leader long, topic_label string, cluster_key string")
    ids = {r["leader"]: r["topic_id"] for r in cluster.cluster_ids(df).collect()}
    keys = ["k2|", "k3|", "k3|:1", "k3|:2", "k4|"]
    short = [r["h"] for r in spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").orderBy("i").select(hash8(F.col("k")).alias("h")).collect()]
    assert ids == {1: "headline-iran-war", **{i + 2: f"headline-iran-war-{short[i]}" for i in range(4)}, 6: f"headline-{short[4]}"}


def test_leaders_follow_ties_to_the_last_cluster(spark):
    nodes = spark.range(1, 8).select(F.col("id").alias("node"))
    pairs = spark.createDataFrame([(1, 3, 0.9), (2, 3, 0.9), (1, 4, 0.8), (3, 5, 0.7), (1, 5, 0.6), (5, 6, 0.5), (4, 6, 0.5)], "left long, right long, score float")
    assert {r["node"]: r["leader"] for r in cluster.leaders(nodes, pairs).collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 2, 6: 2, 7: 7}


def test_labels_count_terms_of_clusters(spark):
    term = lambda *keys: [{"key": k, "label": f"L{k}"} for k in keys]
    rows = [(1, 1, term("a", "b", "c"), "x"), (2, 2, term("c", "d", "e"), "x"), (3, 1, term("d", "z"), "x"), (9, 1, term(), None)]
    nodes = spark.createDataFrame(rows, "node long, n long, terms array<struct<key:string,label:string>>, intent string")
    led = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "node long, leader long")
    got = {r["leader"]: (r["label_terms"], r["cluster_key"]) for r in cluster.cluster_labels(nodes, led).collect()}
    most = cluster.MAX_LABEL_TERMS
    assert got[9] == ([], "|") and got[1][1] == "a-b-c-d-e-z|x"
    assert got[1][0] == ["La", "Lc", "Lc", "Ld", "Le", "La"][:most]


def test_rules_on_distinct_values(spark):
    """The same rows as row by row, with nulls and clashing names, by a broadcast or inline."""
    from tallyspark.functions.rules import answer_of, demographic_of
    from tallyspark.operators import pooling

    rows = [(i, t, a, c, g) for i, (t, a) in enumerate([("generic-ballot", "Democrat"), ("economy-approval", "Approve (Net)"), (None, "Approve"), ("x", None), (None, None)] * 40) for c, g in ((None, None), ("Dem", "Party"), ("Voters", " Registration "), ("Total", None))]
    df = spark.createDataFrame(rows, "_id int, topic_id string, row_label string, column_label string, group_title string").repartition(3)
    for keys, rule in ((("topic_id", "row_label"), answer_of(F.col("topic_id"), F.col("row_label"))), (("column_label", "group_title"), demographic_of(F.col("column_label"), F.col("group_title")))):
        expected = sorted(map(str, df.withColumn("_a", rule).collect()))
        for most in (0, 100):
            assert sorted(map(str, pooling.on_distinct(df, keys, rule, "_a", most).select(*df.columns, "_a").collect())) == expected
    plan = pooling.on_distinct(df, ("topic_id", "row_label"), F.upper("row_label"), "_a")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_terms_do_not_depend_on_what_is_looked_up(spark, monkeypatch):
    texts = [(i, f"Should the tariffs on imports from {c} and the border wall help workers in factories {'x' * (150 + i)}?") for i, c in enumerate(["Canada", "Mexico", "China", "Canada"] * 5)]
    df = spark.createDataFrame([*texts, (99, None), (100, "")], "i long, t string")
    rows = lambda: sorted((r["i"], [tuple(t) for t in r["terms"]], r["signature"], r["intent"]) for r in terms.extract_terms(df, "i", "t").collect())
    all_looked_up = rows()
    for limit, longest in ((3, 160), (1, 3), (0, 160), (100_000, 5)):
        monkeypatch.setattr(terms, "LOOKED_UP", limit)
        monkeypatch.setattr(terms, "LONGEST", longest)
        assert rows() == all_looked_up
    assert len(all_looked_up) == 20


def test_frequent_tokens_are_not_shuffled(spark):
    tokens = spark.range(1000).selectExpr("id AS i", "0 AS _at", "if(id % 3 > 0, 'tariffs', 'borders') AS token")
    plan = terms.with_terms(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
