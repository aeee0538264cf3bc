"""Chart CSV: trends become line graphs, breakouts become crosstabs."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import chart_number, normalize_text


#: Columns of a chart's table.
TABLE = "headers array<string>, body array<array<string>>"


def parse_table(text: str, strict: bool = False) -> list[tuple]:
    """Headers and body of a CSV text, if it has any; strict: quotes that do not fit raise an error."""
    lines = [[" ".join(c.split()) for c in line] for line in csv.reader(io.StringIO(text), strict=strict)]
    body = [line for line in lines[1:] if any(line)]
    if not body or len(lines[0]) < 2:
        return []
    k = len(lines[0])
    return [(lines[0], [(line + [""] * k)[:k] for line in body])]


def parse_table_strictly(text: str) -> list[tuple]:
    return parse_table(text, strict=True)


def csv_cells(charts: DataFrame) -> DataFrame:
    """chart_id, headers and body (rows of texts as long as the headers) of each chart (chart_id, csv text), one row a chart.

    Blank rows are dropped. Charts with fewer than two headers or no row give nothing.
    """

    schema = T.StructType([charts.schema["chart_id"], *T.StructType.fromDDL(TABLE).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chart_id, text in zip(batch["chart_id"], batch["csv"]):
                rows += [(chart_id, *found) for found in parse_table(text or "")]
            yield pd.DataFrame(rows, columns=["chart_id", "headers", "body"])

    return charts.select("chart_id", "csv").mapInPandas(run, schema)


def looks_temporal(text: Column) -> Column:
    """Four digits, or a slash or dash."""
    return text.rlike("^[0-9]{4}$") | text.contains("/") | text.contains("-")


def first_texts() -> Column:
    """The first column of a chart's body, without empty texts."""
    return F.filter(F.transform("body", lambda line: line[0]), lambda text: text != "")


def is_trend() -> Column:
    """Whether the first column is of dates: one at least, and half of those that are not empty."""
    dates = F.size(F.filter(first_texts(), looks_temporal))
    return (dates > 0) & (2 * dates >= F.size(first_texts()))


def trend_charts(cells: DataFrame) -> DataFrame:
    """Ids of charts whose first column is of dates."""
    return cells.where(is_trend()).select("chart_id")


def line_graphs(cells: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """chart_id, x and series of trend charts; a column without header or number is no series, missing numbers are 0.

    trends: ids of the charts to take, by default those of dates, for which nothing is shuffled.
    """
    own = cells.where(is_trend()) if trends is None else cells.join(trends, "chart_id", "left_semi")
    column = lambda k: F.struct(F.get("headers", k).alias("label"), F.transform("body", lambda line: chart_number(F.get(line, k))).alias("values"))
    columns = F.transform(F.sequence(F.lit(1), F.size("headers") - 1), column)
    shown = F.filter(columns, lambda c: (c["label"] != "") & F.exists(c["values"], lambda v: v.isNotNull()))
    filled = F.transform(shown, lambda c: F.struct(c["label"].alias("label"), F.transform(c["values"], lambda v: F.coalesce(v, F.lit(0.0))).alias("values")))
    return own.select("chart_id", first_texts().alias("x"), filled.alias("series")).where((F.size("x") > 0) & (F.size("series") > 0))


def crosstab_cells(cells: DataFrame, trends: DataFrame | None = None, transpose: bool = False) -> DataFrame:
    """Cells of the other charts: the first header is the group, the others are columns; rows without label are dropped."""
    own = cells.where(~is_trend()) if trends is None else cells.join(trends, "chart_id", "left_anti")
    lines = own.select("chart_id", normalize_text(F.col("headers")[0]).alias("group_title"), F.slice("headers", 2, F.size("headers")).alias("_h"), F.posexplode("body").alias("row_idx", "_line"))
    lines = lines.where(F.col("_line")[0] != "")
    pairs = F.arrays_zip(F.col("_h").alias("label"), F.slice("_line", 2, F.size("_line")).alias("text"))
    spread = lines.select("chart_id", "row_idx", F.posexplode(pairs).alias("col_idx", "_c"), F.col("_line")[0].alias("row_label"), "group_title")
    out = spread.select("chart_id", "row_idx", "col_idx", F.col("_c.label").alias("column_label"), F.coalesce(chart_number(F.col("_c.text")), F.lit(0.0)).alias("value"), "row_label", "group_title")
    if not transpose:
        return out
    turned = out.withColumnsRenamed({"row_idx": "_r", "col_idx": "_c", "row_label": "_rl", "column_label": "_cl"})
    return turned.withColumnsRenamed({"_r": "col_idx", "_c": "row_idx", "_rl": "column_label", "_cl": "row_label"})
