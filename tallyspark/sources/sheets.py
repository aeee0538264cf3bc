"""Sheets given as cells (workbook, sheet, row, col, text, number): toplines to bars and crosstab sheets to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import ascii_lower, normalize_text, scale_percent, strip_selected_choice

SHEET = ("workbook", "sheet")


def _cell_text(text: Column) -> Column:
    return F.nullif(normalize_text(F.coalesce(text, F.lit(""))), F.lit(""))


def topline_bars(cells: DataFrame) -> DataFrame:
    """workbook, sheet, question, row, label and value of topline questions.

    A text in column 0 begins a question if the next row that is not empty says "Frequency" and "Valid Percent" in
    columns 2 and 3; its options (column 1) have their percentages in column 3 and end at an empty row. "Total" is not
    an option, and values stay as they are.
    """
    by_row = cells.groupBy(*SHEET, "row").agg(*[F.max(F.when(F.col("col") == k, _cell_text(F.col("text")))).alias(f"c{k}") for k in range(4)], F.max(F.when(F.col("col") == 3, F.col("number"))).alias("percent"), F.max(F.when(F.col("col") == 1, F.lit(1))).alias("_o"))
    filled = by_row.where("c0 is not null or c1 is not null or c2 is not null or c3 is not null or percent is not null")
    order = Window.partitionBy(*SHEET).orderBy("row")
    after = filled.withColumns({"n2": F.lead("c2").over(order), "n3": F.lead("c3").over(order), "gap": F.coalesce(F.col("row") - F.lag("row").over(order) > 1, F.lit(False))})
    starts = F.col("c0").isNotNull() & (F.col("n2") == "Frequency") & (F.col("n3") == "Valid Percent")
    heading = (F.col("c2") == "Frequency") & (F.col("c3") == "Valid Percent")
    # a question holds until the next text in column 0, or an empty row after its heading
    ends = F.col("gap") & ~starts & ~F.coalesce(heading, F.lit(False))
    state = F.when(starts, F.struct(F.col("c0").alias("q"), F.col("row").alias("at"))).when(F.col("c0").isNotNull() | ends, F.struct(F.lit(None).cast("string").alias("q"), F.col("row").alias("at")))
    held = after.withColumn("_s", F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    options = held.where(F.col("_s.q").isNotNull() & F.col("c1").isNotNull() & F.col("percent").isNotNull() & (ascii_lower(F.col("c1")) != "total"))
    return options.select(*SHEET, F.col("_s.q").alias("question"), F.col("_s.at").alias("question_row"), "row", F.col("c1").alias("label"), F.col("percent").alias("value"))


def crosstab_cells(cells: DataFrame) -> DataFrame:
    """workbook, sheet, question, demographic rows and answer blocks of crosstab sheets, one row per value.

    Row 0 names questions where their blocks of columns begin (from column 2), row 1 the answers in pairs of columns
    (option and percent). From row 3 on column 0 names a group, which holds until the next, and column 1 a demographic;
    three empty rows end the sheet. Answers that are totals are dropped, shares become percentages, gaps count as 0.
    The cells of a sheet are shuffled once, as all steps go by sheet.
    """
    clean = cells.repartition(*SHEET).withColumn("text", _cell_text(F.col("text")))
    by_row = clean.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text", "number"))).alias("cells"))
    whole, so_far = Window.partitionBy(*SHEET), Window.partitionBy(*SHEET).orderBy("row")
    named = lambda k: F.first(F.when(F.col("row") == k, F.filter("cells", lambda c: (c["col"] >= 2) & c["text"].isNotNull())), ignorenulls=True).over(whole)
    text_at = lambda k: F.array_max(F.transform(F.filter("cells", lambda c: c["col"] == k), lambda c: c["text"]))
    left = by_row.withColumns({"_blocks": named(0), "_answers": named(1), "group": text_at(0), "demographic": text_at(1)})
    left = left.where("row >= 3 and (group is not null or demographic is not null)")
    gap = F.coalesce(F.col("row") - F.lag("row").over(so_far), F.col("row") - 2) > 3
    held = left.withColumns({"group_title": F.coalesce(F.last("group", ignorenulls=True).over(so_far), F.lit("Overall")), "_ended": gap})
    held = held.withColumn("_ended", F.max("_ended").over(so_far)).where("not _ended and demographic is not null")
    options = held.select(*SHEET, "row", "group_title", "demographic", "cells", "_blocks", F.explode(F.filter("_answers", lambda a: ~F.lower(a["text"]).contains("total"))).alias("_a"))
    # an answer belongs to the last block that begins at its column or before
    block = F.try_element_at(F.filter("_blocks", lambda b: b["col"] <= F.col("_a.col")), F.lit(-1))
    number = F.get(F.filter("cells", lambda c: c["col"] == F.col("_a.col") + 1), F.lit(0))["number"]
    placed = options.withColumn("_b", block).where("_b is not null")
    return placed.select(*SHEET, strip_selected_choice(F.col("_b.text")).alias("question"), F.col("_b.col").alias("start"), F.col("_a.text").alias("answer"), F.col("_a.col").alias("acol"), "row", "group_title", "demographic", F.coalesce(scale_percent(number), F.lit(0.0)).alias("value"))
