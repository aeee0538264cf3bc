"""Poll tables made from the test tables, so that every query's work grows with them.

polls come from orders, cells from lineitem, and question texts from a list of wordings with words of part names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import dealt

SOURCES = ("emerson", "gallup", "ipsos", "yougov")
ANSWERS = ("Strongly approve", "Somewhat approve", "Somewhat disapprove", "Strongly disapprove", "Don't know", "Approve (Net)", "Skipped")
#: (column label, group title); the second and third column of a structure come from these.
COLUMNS = (("Dem", "Party ID"), ("Republican", "Party ID"), ("Male", "Sex"), ("18-29", "Age"), ("Rural", "Area Type"), ("White", "Race"), ("Independent", "Party ID"))
#: Question wordings: title and prompt.
QUESTIONS = (
    ("Trump approval", "Do you approve or disapprove of the job Donald Trump is doing as president?"),
    ("2026-04-28: Direction of the country", "Would you say things are going in the right direction or are off on the wrong track?"),
    ("Generic ballot", "If the election for U.S. Congress were held today, would you vote for the Democratic or the Republican candidate?"),
    ("CP1. Main problem", "In your opinion, what is the most important problem facing the country?"),
    ("Economy", "Do you approve of how the president is handling the economy?"),
    ("15. Inflation", "How worried are you about inflation and rising prices?"),
    ("Immigration approval", "Do you approve of the way immigration is handled?"),
    ("2026-04-21: Weekly tracker: TM1128Y17_25. Foreign policy", "Do you approve of the handling of foreign policy?"),
    ("Donald Trump favorability", "Do you have a favorable or unfavorable opinion of Donald Trump?"),
    ("Support for Iran War", "Do you support or oppose U.S. military action against Iran?"),
    ("Iran strikes", "Do you support or oppose the U.S. military strikes against Iran?"),
    ("Sports betting", "Do you support or oppose legal online sports betting in your state?"),
    ("Online gambling", "Do you support or oppose legal online gambling in your state?"),
    ("Artificial intelligence", "Have you heard about artificial intelligence tools in schools?"),
    ("AI at work", "Have you heard about AI tools at work and in schools?"),
    ("Favorability of public figures – Senator Smith", "Favorability of these public figures – Senator Smith"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, n: Column) -> Column:
    """The nth of fixed values."""
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


def poll_columns() -> dict[str, Column]:
    """Columns of a poll, from a row of orders."""
    source = F.pmod("o_custkey", F.lit(4))
    return {
        "poll_key": F.col("o_orderkey"),
        "source_id": pick(SOURCES, source),
        "source_rank": source.cast("int"),
        "published_on": F.col("o_orderdate").cast("date"),
        "article_url": F.concat(F.lit("poll-"), F.floor(F.col("o_orderkey") / 2).cast("string")),
        "question_no": F.pmod("o_orderkey", F.lit(len(QUESTIONS))).cast("int"),
    }


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poll_key, source_id, source_rank, published_on, article_url, question_no, title, prompt."""
    frame = table(spark, sf_dir, "orders").select(*[c.alias(n) for n, c in poll_columns().items()])
    return with_question(frame)


def with_question(df: DataFrame) -> DataFrame:
    return df.withColumns({"title": pick(tuple(t for t, _ in QUESTIONS), F.col("question_no")), "prompt": pick(tuple(p for _, p in QUESTIONS), F.col("question_no"))})


def cells(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """One row per answer row and column of a crosstab; a structure is an order, an answer row a line number of it.

    own: polls, all by default; further columns of it are kept, so that topics can be matched and pruned by poll
    before the join with the lines. Lines lie by order before they are added up, so that the join, the explosion into
    columns and what goes by structure afterwards need no further shuffle of them.
    """
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"))
    own = polls(spark, sf_dir) if own is None else own
    kept = [c for c in own.columns if c not in ("poll_key", "article_url")]
    joined = rows.join(own, rows["l_orderkey"] == own["poll_key"])
    labels, groups = tuple(c for c, _ in COLUMNS), tuple(g for _, g in COLUMNS)
    first, second = F.pmod("poll_key", F.lit(7)), F.pmod("poll_key", F.lit(5))
    none = F.lit(None).cast("string")
    column = lambda i, label, group: F.struct(F.lit(i).alias("col_idx"), label.alias("column_label"), group.alias("group_title"))
    columns = F.explode(F.array(column(0, F.lit("Total"), none), column(1, pick(labels, first), pick(groups, first)), column(2, pick(labels, second), pick(groups, second))))
    wide = joined.select("poll_key", *kept, F.col("l_linenumber").alias("row_idx"), pick(ANSWERS, F.col("l_linenumber") - 1).alias("row_label"), "quantity", columns.alias("c"))
    return wide.select(F.col("poll_key").alias("structure_idx"), *kept, F.lit(0).alias("panel_idx"), "row_idx", "row_label", "c.col_idx", "c.column_label", "c.group_title", (F.col("quantity") + F.col("c.col_idx") * F.pmod("row_idx", F.lit(3))).alias("value"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per part and wording: obs_id, obs_ord, source, title, prompt with words of the part's name."""
    part = table(spark, sf_dir, "part")
    frame = part.select(
        F.col("p_partkey").alias("obs_ord"),
        F.concat_ws(":", pick(SOURCES, F.pmod("p_partkey", F.lit(4))), F.col("p_partkey").cast("string")).alias("obs_id"),
        pick(SOURCES, F.pmod("p_partkey", F.lit(4))).alias("source_id"),
        F.pmod("p_partkey", F.lit(len(QUESTIONS))).cast("int").alias("question_no"),
        "p_name",
        "p_type",
        "p_size",
    )
    return with_question(frame)


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structure per order with lines, of the five kinds in turn, in the schema of a collection; charts ask in their titles."""
    own = polls(spark, sf_dir).withColumns({"collection_title": F.concat(F.lit("week "), F.weekofyear("published_on").cast("string")), "collection_subtitle": F.when(F.pmod("poll_key", F.lit(3)) > 0, F.concat(F.lit("released "), F.col("published_on").cast("string")))})
    rows = cells(spark, sf_dir, own).groupBy("source_rank", "structure_idx", "source_id", "collection_title", "collection_subtitle", "title", "prompt", "row_idx", "row_label")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("col_idx", "column_label", "group_title", "value"))).alias("c"))
    made = rows.groupBy("source_rank", "structure_idx", "source_id", "collection_title", "collection_subtitle", "title", "prompt").agg(F.sort_array(F.collect_list(F.struct("row_idx", "row_label", "c"))).alias("r"))
    kind = pick(("Crosstab", "BarGraph", "PieChart", "LineGraph", "Unstructured"), F.pmod("structure_idx", F.lit(5)))
    total = lambda v: F.get(v["c"], F.lit(0))["value"]
    head = F.get("r", F.lit(0))["c"]
    groups = F.transform(F.slice(head, 2, 2), lambda c: F.struct(c["group_title"].alias("title"), F.array(c["column_label"]).alias("labels")))
    panel = F.struct(F.transform(head, lambda c: c["column_label"]).alias("columns"), groups.alias("groups"), F.transform("r", lambda v: F.struct(v["row_label"].alias("label"), F.transform(v["c"], lambda c: c["value"]).alias("values"))).alias("rows"))
    wording = F.concat_ws(" ", "title", "prompt")
    of = lambda name, column: F.when(F.col("type") == name, column)
    return made.withColumn("type", kind).select(
        "source_rank", "structure_idx", "source_id", "collection_title", "collection_subtitle", "type", F.when(F.col("type") == "Crosstab", F.col("title")).when(F.col("type") != "Unstructured", wording).alias("title"), of("Crosstab", F.col("prompt")).alias("prompt"), F.lit("%").alias("y_unit"),
        of("Unstructured", F.concat(wording, F.lit("\nno table"))).alias("data"), of("BarGraph", F.transform("r", lambda v: v["row_label"])).alias("x"), of("BarGraph", F.transform("r", total)).alias("y"),
        of("PieChart", F.transform("r", lambda v: F.struct(v["row_label"].alias("label"), total(v).alias("value")))).alias("slices"),
        of("LineGraph", F.transform("r", lambda v: F.struct(v["row_label"].alias("label"), F.array(total(v) - 1, total(v)).alias("values")))).alias("series"), of("Crosstab", F.array(panel)).alias("panels"),
    )
