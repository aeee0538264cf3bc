"""The jobs that answer a user's questions, and raw inputs made of the test tables for the source parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rules import ROLLUP
from ..functions.text import iso_date_text
from ..operators import cluster, headlines, pooling, question_index, terms
from ..shared import dealt, materialize
from ..sources.toplines import TEMPLATES
from . import views


def pooled_topic(cells: DataFrame, topic: str) -> DataFrame:
    """One topic's pooled answers by demographic, total first."""
    return pooling.pool(pooling.topic_answers(cells, topic)).orderBy(*pooling.pooled_order())


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per part: matched topic or headline candidate, poll date, answers and fingerprint."""
    asked = materialize(pooling.with_topic(views.questions(spark, sf_dir)), "matched-questions")
    asked = asked.withColumn("prompt", F.when(F.col("topic_id").isNull(), F.concat_ws(" ", F.col("p_name"), F.col("prompt"))).otherwise(F.col("prompt")))
    found = terms.headline_candidates(asked).withColumnsRenamed({"topic_id": "_id", "topic_label": "_label"})
    named = asked.join(found, "obs_id", "left").where("topic_id is not null or _id is not null")
    labels = F.array_sort(F.array(F.concat(F.lit("approve: "), F.col("p_type")), F.lit("unsure: Unsure")))
    seen = named.select(
        "obs_id", "obs_ord", "source_id", "title", "prompt", F.coalesce("topic_id", "_id").alias("topic_id"), F.coalesce("_label", "title").alias("topic_label"), F.coalesce("compatibility", F.lit(ROLLUP)).alias("compatibility"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("source_collection"), iso_date_text(F.concat_ws(" ", "title", "prompt")).alias("poll_date"), labels.alias("answer_labels"), F.lit(None).cast("string").alias("answer_text"),
    )
    return materialize(question_index.with_fingerprint(seen), "observations")


def derived_index(seen: DataFrame) -> DataFrame:
    """An index with a record for every third fingerprint."""
    some = seen.where(F.col("topic_id").startswith("headline-candidate-")).groupBy("question_fingerprint").agg(F.min(F.struct("obs_ord", "source_id", "title")).alias("f"))
    n = F.pmod("f.obs_ord", F.lit(6))
    return some.where(F.pmod("f.obs_ord", F.lit(3)) == 0).select(
        "question_fingerprint", F.col("f.source_id").alias("source_id"), F.when(n == 0, F.concat(F.lit("/api/v1/topics/"), F.col("f.title"))).otherwise("").alias("canonical_topic_id"), F.when(n == 0, "").otherwise(F.col("f.title")).alias("canonical_label"),
        F.when(F.pmod("f.obs_ord", F.lit(9)) == 0, 0.5).otherwise(0.9).alias("confidence"), F.lit(None).cast("string").alias("exclude_reason"), F.lit("seed").alias("model"), F.lit("accepted").alias("review_status"),
    )


def clustered(seen: DataFrame) -> DataFrame:
    """Clusters of the headline candidates."""
    rest = seen.where(F.col("topic_id").startswith("headline-candidate-"))
    found = terms.observation_terms(rest).join(rest.select("obs_id", "obs_ord"), "obs_id")
    return cluster.cluster_questions(found)


def headline_topics(seen: DataFrame, min_polls: int = 2) -> DataFrame:
    """Recurring topics after clustering, ranked; candidates without enough terms keep their own id."""
    groups = clustered(seen).select("obs_ord", F.col("topic_id").alias("_id"), F.col("topic_label").alias("_label"))
    named = seen.join(groups, "obs_ord", "left").withColumns({"topic_label": F.coalesce("_label", "topic_label"), "topic_id": F.coalesce("_id", "topic_id")}).drop("_id", "_label")
    return headlines.headline_summaries(named, min_polls).orderBy(*headlines.headline_order())


def enrichment_batch(seen: DataFrame, index: DataFrame) -> DataFrame:
    """Classify questions without a record by the rules, and merge the accepted replies into the index."""
    asked = question_index.new_questions(seen, index)
    records = question_index.classify_by_rules(asked).where("not rejected")
    keep = index.columns
    return question_index.upsert(index, records.select(*keep))


def feature_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets of the candidates' wordings, one node per intent and signature."""
    seen = observations(spark, sf_dir)
    rest = seen.where(F.col("topic_id").startswith("headline-candidate-"))
    found = terms.observation_terms(rest).join(rest.select("obs_id", "obs_ord"), "obs_id")
    return materialize(found.groupBy(F.coalesce("intent", F.lit("")).alias("intent"), "signature").agg(F.min("obs_ord").alias("node"), F.min_by("features", "obs_ord").alias("features")), "feature-nodes")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets of parts: words of name and type, size, and a general word, one node per brand (as intent) and signature."""
    part = views.table(spark, sf_dir, "part")
    own = F.array(F.concat(F.lit("size"), F.col("p_size").cast("string")), views.pick(("approval", "price", "policy"), F.pmod("p_partkey", F.lit(3))))
    features = F.sort_array(F.array_distinct(F.concat(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "), own)))
    nodes = part.select(F.col("p_partkey").alias("obs_ord"), F.col("p_brand").alias("intent"), features.alias("features"))
    return nodes.groupBy("intent", F.array_join("features", " ").alias("signature")).agg(F.min("obs_ord").alias("node"), F.min_by("features", "obs_ord").alias("features"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by order, so that sums by line and texts by order need no further shuffle."""
    return dealt(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_orderkey")


def chart_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart_id and csv: the lines of an order as a trend by year, or as a breakout by answer."""
    rows = order_lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    trend = F.pmod("l_orderkey", F.lit(2)) == 0
    label = F.when(trend, (F.col("l_linenumber") + 2000).cast("string")).otherwise(views.pick(views.ANSWERS, F.col("l_linenumber") - 1))
    line = F.concat_ws(",", label, F.col("v").cast("int").cast("string"), F.concat(F.col("v").cast("int").cast("string"), F.lit("%")), F.lit("n/a"))
    return rows.groupBy(F.col("l_orderkey").alias("chart_id")).agg(F.concat(F.when(F.first(trend), "Year").otherwise("Breakouts"), F.lit(",Approve,Disapprove,\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n,,,\n")).alias("csv"))


def _cell(row, col, text=None, number=None):
    return F.struct(F.lit(row).cast("int").alias("row") if not hasattr(row, "cast") else row.cast("int").alias("row"), F.lit(col).cast("int").alias("col"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if number is None else number).cast("double").alias("number"))


def topline_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet per order: one question, its heading, an option per line, and a total."""
    rows = order_lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    options = F.array(_cell(F.col("l_linenumber") + 2, 1, views.pick(views.ANSWERS, F.col("l_linenumber") - 1)), _cell(F.col("l_linenumber") + 2, 3, None, F.col("v")))
    body = rows.select("l_orderkey", F.explode(options).alias("c"))
    head = rows.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(_cell(1, 0, F.concat(F.lit("Question "), F.col("l_orderkey").cast("string"))), _cell(2, 2, F.lit("Frequency")), _cell(2, 3, F.lit("Valid Percent")), _cell(10, 1, F.lit("Total")), _cell(10, 3, None, F.lit(100.0)))).alias("c"))
    # rows that an order lacks are filled with an option that has no percentage, so that they are not empty
    gaps = rows.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.transform(F.sequence(F.lit(3), F.lit(9)), lambda r: F.struct(r.alias("row"), F.lit(2).alias("col"), F.lit("-").alias("text"), F.lit(None).cast("double").alias("number")))).alias("c"))
    return head.unionByName(body).unionByName(gaps).select(F.col("l_orderkey").alias("workbook"), F.lit("s").alias("sheet"), "c.*")


def crosstab_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet per order: one question with two answers, groups of two demographics, a row per line."""
    rows = order_lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    at = F.col("l_linenumber") + 2
    group = F.when(F.pmod("l_linenumber", F.lit(2)) == 1, F.concat(F.lit("Group "), ((F.col("l_linenumber") + 1) / 2).cast("int").cast("string")))
    body = rows.select("l_orderkey", F.explode(F.array(_cell(at, 0, group), _cell(at, 1, F.concat(F.lit("Demo "), F.col("l_linenumber").cast("string"))), _cell(at, 3, None, F.col("v") / 100), _cell(at, 5, None, F.col("v")))).alias("c"))
    head = rows.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(_cell(0, 2, F.lit("Do you approve? - Selected Choice")), _cell(1, 2, F.lit("Approve")), _cell(1, 4, F.lit("Disapprove")), _cell(1, 6, F.lit("Total")), _cell(3, 0, F.lit("Group 1")))).alias("c"))
    return head.unionByName(body).groupBy("l_orderkey", "c.row", "c.col").agg(F.max("c.text").alias("text"), F.max("c.number").alias("number")).select(F.col("l_orderkey").alias("workbook"), F.concat(F.lit("s"), F.pmod("l_orderkey", F.lit(3)).cast("string")).alias("sheet"), "row", "col", "text", "number")


def topline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order: a question, two columns with sample sizes, a row per line."""
    rows = order_lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    line = F.concat(views.pick(views.ANSWERS, F.col("l_linenumber") - 1), F.lit(" "), F.col("v").cast("int").cast("string"), F.lit("% "), F.when(F.pmod("l_linenumber", F.lit(3)) == 0, "*").otherwise(F.col("l_linenumber").cast("string")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("CP1. In your opinion, is it good?\nTotal\n(N=1,269)\nIndependent/Something\nelse (N=451)\n"), body, F.lit("\nwww.ipsos.com\n12\n")).alias("text"))


def panel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order in the layout with fixed templates: a question, a panel header, a row of twelve percentages per line; where a line is returned the header is missing."""
    rows = order_lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("int").alias("v"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.concat((F.col("v") + k).cast("string"), F.lit("%"))), " ")
    line = F.concat_ws(" ", views.pick(views.ANSWERS, F.col("l_linenumber") - 1), numbers)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n")
    head = F.when(F.max("r") == 1, "").otherwise("Sex Race Age Education\n")
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("The Poll\n15. Support for the war\n"), head, body, F.lit("\nTotals 100% 100%\n")).alias("text"))


def raw_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart per order as bytes, with a ragged row; of ten in turn one is not UTF-8, one ends in an open quote, one has no rows, one is null, and one has a quoted comma and newline."""
    rows = order_lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("int").alias("v"))
    line = F.concat_ws(",", views.pick(views.ANSWERS, F.col("l_linenumber") - 1), F.col("v").cast("string"), F.when(F.col("l_linenumber") > 1, F.col("v").cast("string")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n")
    made = rows.groupBy(F.col("l_orderkey").alias("chart_id")).agg(F.concat(F.lit("Answer,All,Men\n"), body).alias("csv"))
    k, text = F.pmod("chart_id", F.lit(10)), F.col("csv")
    bad = F.when(k == 0, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("FF")))).when(k == 1, F.encode(F.concat(text, F.lit('\n"open')), "UTF-8")).when(k == 2, F.encode(F.lit("Answer,All\n,\n"), "UTF-8"))
    content = bad.when(k == 4, F.encode(F.concat(text, F.lit('\n"one, and\ntwo",3')), "UTF-8")).when(k != 3, F.encode(text, "UTF-8"))
    return made.select(views.pick(views.SOURCES, F.pmod("chart_id", F.lit(4))).alias("source_id"), "chart_id", content.alias("content"))


def paged_panel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order in the layout with fixed templates, as pages come out: a contents line, a question with a prompt of two lines, both panels with page
    furniture in and between them and a label of two lines, a title without a panel, and a question of one panel whose first line is the order's number."""
    rows = order_lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("int").alias("v"))
    percents = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat((F.col("v") + k).cast("string"), F.lit("%"))), " ")
    label = views.pick(views.ANSWERS, F.col("l_linenumber") - 1)
    body = lambda line: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n")
    first, cut, second = F.concat_ws(" ", label, percents(12)), F.concat(F.lit("Other or\n7\n"), label, F.lit(" "), percents(12)), F.concat_ws(" ", label, percents(11))
    page = "\n\n4\nThe Economist/YouGov Poll\nApril 1 - 4, 2026 - 1,500 U.S. Adult Citizens\n"
    columns = [" ".join(t[1]) for t in TEMPLATES]
    text = F.concat(
        F.lit("The Economist/YouGov Poll\n15. Support for the war . . . . 3\n15. Support for the war\nDo you support or oppose\n3\nthe war of order "), F.col("l_orderkey").cast("string"), F.lit(f"?\n{TEMPLATES[0][0]}\n{columns[0]}\n"),
        body(first), F.lit(f"\nTotals 100% 100%\nUnweighted N (1,500) (700)\n{page}{TEMPLATES[1][0]}\n{columns[1]}\n"), body(second), F.lit(page), F.lit("16. A title without a panel\nand its text\nThe Economist/YouGov Poll\n17A. Trust\n"),
        F.col("l_orderkey").cast("string"), F.lit(f"\n{TEMPLATES[0][0]}\n"), body(cut), F.lit("\nTotals 100% 100%\n"),
    )
    return rows.groupBy("l_orderkey").agg(text.alias("text")).select(F.col("l_orderkey").alias("doc_id"), "text")


def named_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations with a part's name and type as fingerprint, and an index of all fingerprints but those of one type, with records of every kind."""
    part = views.table(spark, sf_dir, "part")
    key = F.concat_ws("|", "p_name", "p_type")
    seen = part.select(
        key.alias("question_fingerprint"), F.col("p_partkey").alias("obs_ord"), F.col("p_name").alias("title"), F.col("p_name").alias("topic_label"), F.lit("own").alias("compatibility"),
        F.when(F.col("p_size") <= 30, F.concat(F.lit("headline-candidate-"), F.col("p_partkey").cast("string"))).otherwise("generic-ballot").alias("topic_id"),
    )
    first = part.where("p_type <> 'ECONOMY'").groupBy("p_name", "p_type").agg(F.pmod(F.min("p_partkey"), F.lit(4)).alias("k"))
    given = views.pick(("/api/v1/topics/", "", "generic-ballot", " headline-us-"), F.col("k"))
    index = first.select(
        key.alias("question_fingerprint"), F.concat(given, F.when(F.col("k") == 0, F.col("p_name")).when(F.col("k") == 3, F.concat("p_type", F.lit(" "))).otherwise("")).alias("canonical_topic_id"), F.when(F.col("k") == 1, F.concat("p_name", F.lit(" AI"))).otherwise("").alias("canonical_label"),
        F.when(F.col("p_type") == "PROMO", 0.5).otherwise(0.9).alias("confidence"), F.when(F.col("p_name").startswith("large"), "off topic").alias("exclude_reason"),
    )
    return seen, index
