"""Chart data: options, trend series, latest bars, and wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import base_question, title_prefix
from ..shared import materialize


def options(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct base questions, and distinct columns of first panels by question, each with its first place."""
    named = cells.withColumn("question", base_question(F.col("title"), F.col("prompt")))
    questions = named.groupBy("question").agg(F.min("structure_idx").alias("first_seen"))
    columns = named.where("panel_idx = 0").groupBy("question", "column_label").agg(F.min(F.struct("structure_idx", "col_idx")).alias("_f"))
    return questions, columns.select("question", "column_label", F.col("_f.structure_idx").alias("first_seen"), F.col("_f.col_idx").alias("first_col"))


def _at_column(cells: DataFrame, demographic: str) -> DataFrame:
    """Cells of the first panel at the demographic's column, by name without regard to case, else at the first column."""
    panel = cells.where("panel_idx = 0")
    wanted = panel.groupBy("structure_idx").agg(F.coalesce(F.min(F.when(F.lower("column_label") == demographic.lower(), F.col("col_idx"))), F.min("col_idx")).alias("_col"))
    return panel.join(wanted, "structure_idx").where("col_idx = _col").drop("_col")


def _first_value(cells: DataFrame, demographic: str, *keys: str) -> DataFrame:
    """keys and value: of each group the first row's value at the demographic's column of the first panel, as in _at_column."""
    other = ~F.coalesce(F.lower("column_label") == demographic.lower(), F.lit(False))
    return cells.where("panel_idx = 0").groupBy(*keys).agg(F.min_by("value", F.struct(other.alias("other"), "col_idx", "row_idx")).alias("value"))


def numbered(df: DataFrame, group: str, order: str, out: str = "place") -> DataFrame:
    """df with the place of each row in its group, largest `order` first, from 1.

    Rows are dealt by ranges of (group, order) and written; a row's place is the rows of its group in the ranges before
    its own, which are few numbers, and its place within its range. So a group with most of the rows is many tasks.
    """
    dealt = materialize(df.repartitionByRange(F.col(group), F.col(order).desc()).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_range").orderBy(F.col(order).desc())
    placed = dealt.withColumn("_at", F.row_number().over(within))
    joined = placed.join(starts, placed[group].eqNullSafe(starts["_group"]) & (placed["_range"] == starts["_of"]))
    return joined.select(*df.columns, (F.col("_start") + F.col("_at")).cast("int").alias(out))


def trend_series(cells: DataFrame, question: str, demographic: str) -> DataFrame:
    """place, label and value over time: the first answer row of each structure with the question, oldest first."""
    match = cells.where(base_question(F.col("title"), F.col("prompt")) == question).withColumn("question", F.lit(question))
    placed = numbered(_first_value(match, demographic, "question", "structure_idx", "title"), "question", "structure_idx")
    return placed.select("place", F.concat(title_prefix(F.col("title")), F.lit(" (Poll "), F.col("place").cast("string"), F.lit(")")).alias("label"), "value")


def trend_by_question(cells: DataFrame, demographic: str) -> DataFrame:
    """The same for all questions at once, numbered within each question."""
    named = cells.withColumn("question", base_question(F.col("title"), F.col("prompt")))
    return numbered(_first_value(named, demographic, "question", "structure_idx"), "question", "structure_idx")


def latest_bars(cells: DataFrame, demographic: str) -> DataFrame:
    """Per question the answer rows of its first structure at the demographic's column."""
    named = cells.withColumn("question", base_question(F.col("title"), F.col("prompt")))
    first = named.groupBy("question").agg(F.min("structure_idx").alias("structure_idx"))
    own = named.join(first, ["question", "structure_idx"], "left_semi")
    return _at_column(own, demographic).select("question", "structure_idx", "row_idx", "row_label", F.coalesce("value", F.lit(0.0)).alias("value"))


def wide_rows(cells: DataFrame, labels: list[str], name: Column | None = None) -> DataFrame:
    """One row per structure and answer row with a column for each label; null where there is none."""
    pivoted = cells.groupBy("structure_idx", "row_idx", "row_label").pivot("column_label", labels).agg(F.min_by("value", "col_idx"))
    return pivoted


def line_rows(structures: DataFrame) -> DataFrame:
    """structure keys, x and a map of series label to value at each place of a line graph; missing values are null."""
    places = structures.where("type = 'LineGraph'").select("source_rank", "structure_idx", "series", F.posexplode("x").alias("place", "x"))
    return places.select("source_rank", "structure_idx", "place", "x", F.map_from_entries(F.transform("series", lambda s: F.struct(s["label"], F.get(s["values"], F.col("place"))))).alias("values"))
