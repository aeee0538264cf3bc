"""From cells to answers, rolled up, without repeated demographics, and pooled over observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import answer_of, demographic_of, structure_text, topic_match
from ..functions.text import normalize_text
from ..shared import materialize

STRUCTURE = ("source_rank", "structure_idx")
#: Distinct values up to which the results of a rule table are sent to all tasks.
MOST_VALUES = 100_000


def on_distinct(df: DataFrame, keys: Sequence[str], rule: Column, out: str, most: int = MOST_VALUES, values: DataFrame | None = None) -> DataFrame:
    """Add a rule table's result, evaluated once for each distinct combination of the columns that it looks at.

    Labels and titles repeat in all polls, while a rule table is a long condition. The results of up to `most`
    combinations are joined back by a broadcast; where there are more, the rule is evaluated row by row, which needs no
    shuffle either. The keys may be null. df is read once more for its combinations, but for those in `values`, a
    written table of its rows' keys.
    """
    values = materialize(df.select(*keys).distinct(), "rule-keys") if values is None else values.select(*keys).distinct()
    if values.count() > most:
        return df.withColumn(out, rule)
    found = values.withColumn(out, rule).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [df[k].eqNullSafe(found[f"_of_{k}"]) for k in keys]
    return df.join(F.broadcast(found), same, "left").drop(*[f"_of_{k}" for k in keys])


def with_topic(df: DataFrame) -> DataFrame:
    """Add topic_id and compatibility of the title and prompt; null where no rule matches."""
    hit = topic_match(F.col("source_id"), structure_text(F.col("title"), F.col("prompt")))
    matched = on_distinct(df, ("source_id", "title", "prompt"), hit, "_topic")
    return matched.withColumns({"topic_id": F.col("_topic.topic_id"), "compatibility": F.col("_topic.compatibility")}).drop("_topic")


def with_demographic(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Add demographic_id, demographic_label, group_id and group_label of a column label and its group."""
    named = on_distinct(df, ("column_label", "group_title"), demographic_of(F.col("column_label"), F.col("group_title")), "_demo", values=values)
    return named.select("*", F.col("_demo.id").alias("demographic_id"), F.col("_demo.label").alias("demographic_label"), "_demo.group_id", "_demo.group_label").drop("_demo")


def first_group(columns: Column, groups: Column) -> Column:
    """For each column label of a panel the title of the first group that lists it, as an array; null without one."""
    own = lambda label: F.get(F.filter(groups, lambda g: F.array_contains(g["labels"], normalize_text(label))), F.lit(0))["title"]
    return F.transform(columns, own)


def panel_cells(structures: DataFrame, keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """Cells of crosstab panels: keys, panel_idx, row_idx, row_label, col_idx, column_label, group_title, value.

    structures: keys, panels (array of columns, groups and rows). A row that is shorter than the columns skips them.
    """
    panels = structures.select(*keys, F.posexplode("panels").alias("panel_idx", "panel"))
    panels = panels.withColumn("titles", first_group(F.col("panel.columns"), F.col("panel.groups")))
    rows = panels.select(*keys, "panel_idx", "panel.columns", "titles", F.posexplode("panel.rows").alias("row_idx", "row"))
    cells = rows.select(*keys, "panel_idx", "row_idx", F.col("row.label").alias("row_label"), F.posexplode(F.arrays_zip(F.col("columns").alias("label"), F.col("titles").alias("title"), F.col("row.values").alias("value"))).alias("col_idx", "cell"), F.size("row.values").alias("_n"), F.size("columns").alias("_c"))
    return cells.where("col_idx < _n and col_idx < _c").select(*keys, "panel_idx", "row_idx", "row_label", "col_idx", F.col("cell.label").alias("column_label"), F.col("cell.title").alias("group_title"), F.col("cell.value").alias("value"))


def chart_cells(structures: DataFrame, keys: Sequence[str] = STRUCTURE) -> DataFrame:
    """Cells of bar, pie and line charts, all of the demographic "Total": a line gives its last value."""
    point = lambda label, value, given=F.lit(True): F.struct(label.alias("label"), value.alias("value"), given.alias("given"))
    bars = F.slice(F.zip_with("x", "y", lambda label, value: point(label, value)), F.lit(1), F.least(F.size("x"), F.size("y")))
    lines = F.transform("series", lambda s: point(s["label"], F.try_element_at(s["values"], F.lit(-1)), F.size(s["values"]) > 0))
    points = F.when(F.col("type") == "BarGraph", bars).when(F.col("type") == "PieChart", F.transform("slices", lambda p: point(p["label"], p["value"]))).when(F.col("type") == "LineGraph", lines)
    placed = structures.select(*keys, F.posexplode(points).alias("row_idx", "p")).where("p.given")
    total = [F.lit(0).alias("col_idx"), F.lit("Total").alias("column_label"), F.lit(None).cast("string").alias("group_title")]
    return placed.select(*keys, F.lit(0).alias("panel_idx"), "row_idx", F.col("p.label").alias("row_label"), *total, F.col("p.value").alias("value"))


def roll_up(cells: DataFrame, keys: Sequence[str], topic_col: str = "topic_id") -> DataFrame:
    """keys, answer_id, answer_label, value: labels mapped to answers.

    Components of an answer (priority 1) are added up; a row of higher priority, such as a net row, replaces them, the
    first one if there are several.
    """
    return _summed(on_distinct(cells, (topic_col, "row_label"), answer_of(F.col(topic_col), F.col("row_label")), "_a"), keys)


def _summed(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll-up of cells whose answer is known (_a)."""
    mapped = cells.select("*", F.col("_a.id").alias("answer_id"), F.col("_a.label").alias("_label"), F.col("_a.priority").alias("_p")).drop("_a")
    summed = mapped.groupBy(*keys, "answer_id").agg(
        F.max("_p").alias("_top"),
        F.expr("sum(value) filter (where _p = 1)").alias("_sum"),
        F.expr("min_by(value, row_idx) filter (where _p = 3)").alias("_net"),
        F.expr("min_by(_label, row_idx) filter (where _p = 1)").alias("_sum_label"),
        F.expr("min_by(_label, row_idx) filter (where _p = 3)").alias("_net_label"),
    )
    net = F.col("_top") == 3
    return summed.select(*keys, "answer_id", F.when(net, F.col("_net_label")).otherwise(F.col("_sum_label")).alias("answer_label"), F.when(net, F.col("_net")).otherwise(F.col("_sum")).alias("value"))


def answers_of(cells: DataFrame) -> DataFrame:
    """Answers of each structure and demographic; the first of several columns with one demographic counts.

    cells: structure keys, topic_id, panel_idx, col_idx, row_idx, labels and value. One exchange serves the removal of
    repeated demographics and the roll-up, as both go by structure and demographic; cells that lie by structure already
    are not moved at all.
    """
    values = materialize(cells.select("topic_id", "row_label", "column_label", "group_title").distinct(), "rule-keys")
    named = on_distinct(with_demographic(cells, values), ("topic_id", "row_label"), answer_of(F.col("topic_id"), F.col("row_label")), "_a", values=values)
    column = Window.partitionBy(*STRUCTURE, "demographic_id")
    first = named.withColumn("_first", F.min(F.struct("panel_idx", "col_idx")).over(column)).where((F.col("panel_idx") == F.col("_first.panel_idx")) & (F.col("col_idx") == F.col("_first.col_idx"))).drop("_first")
    keys = [*STRUCTURE, "source_id", "topic_id", "demographic_id", "demographic_label", "group_id", "group_label"]
    return _summed(first, keys)


def pool(answers: DataFrame, by: Sequence[str] = ("topic_id",)) -> DataFrame:
    """Unweighted mean and count of each answer over observations; labels are those of the first observation.

    Exposes answer_id, by which answers are grouped, and id, which is the label. All aggregates have partial sums, so a
    topic or demographic with most of the rows does not meet in one task.
    """
    order = F.struct(*STRUCTURE)
    first = lambda c: F.min_by(c, order)
    by_answer = answers.groupBy(*by, "demographic_id", "answer_id").agg(
        F.avg("value").alias("value"), F.count("*").alias("observation_count"), first("answer_label").alias("id"), F.min(F.struct(order.alias("o"), F.struct("demographic_label", "group_id", "group_label").alias("d"))).alias("_first")
    )
    # the demographic as its first observation has it: over the few rows of its answers
    named = by_answer.withColumn("_d", F.min("_first").over(Window.partitionBy(*by, "demographic_id"))["d"])
    return named.select(*by, "demographic_id", "_d.demographic_label", "_d.group_id", "_d.group_label", "answer_id", "id", "value", "observation_count")


def pool_state(answers: DataFrame, by: Sequence[str] = ("topic_id",)) -> DataFrame:
    """What pooling needs of answers, one row a group and answer: sum, count, and labels of the first observation."""
    order = F.struct(*STRUCTURE)
    first = F.min(F.struct(order.alias("o"), F.struct("answer_label", "demographic_label", "group_id", "group_label").alias("d"))).alias("first")
    return answers.groupBy(*by, "demographic_id", "answer_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.count("value").alias("n_values"), first)


def merge_pool_states(old: DataFrame, new: DataFrame, by: Sequence[str] = ("topic_id",)) -> DataFrame:
    """The state of both sets of answers, which have no observation in common."""
    return old.unionByName(new).groupBy(*by, "demographic_id", "answer_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.min("first").alias("first"))


def pooled_of_state(state: DataFrame, by: Sequence[str] = ("topic_id",)) -> DataFrame:
    """The rows of pool() from a state: means and counts; a demographic is named as its first observation names it."""
    own = state.withColumn("_d", F.min("first").over(Window.partitionBy(*by, "demographic_id"))["d"])
    named = [F.col(f"_d.{c}").alias(c) for c in ("demographic_label", "group_id", "group_label")]
    return own.select(*by, "demographic_id", *named, "answer_id", F.col("first.d.answer_label").alias("id"), (F.col("total") / F.when(F.col("n_values") > 0, F.col("n_values"))).alias("value"), F.col("n").alias("observation_count"))


def pooled_order() -> list[Column]:
    """Total first, then demographics and answers by id."""
    return [F.expr("demographic_id <> 'total'"), F.col("demographic_id"), F.col("id")]


def nest_pooled(pooled: DataFrame) -> DataFrame:
    """One row per topic and demographic with its answers as an array, for nested sinks."""
    return pooled.groupBy("topic_id", "demographic_id", "demographic_label", "group_id", "group_label").agg(F.sort_array(F.collect_list(F.struct("id", "value", "observation_count"))).alias("answers"))


def write_pooled(pooled: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per topic."""
    nest_pooled(pooled).repartition("topic_id").write.mode("overwrite").partitionBy("topic_id").format(fmt).save(path)


def topic_answers(cells: DataFrame, topic: str | None = None) -> DataFrame:
    """Answers of the structures that a topic rule matches, or of one topic only; pruned before anything is shuffled."""
    matched = (cells if "topic_id" in cells.columns else with_topic(cells)).where(F.col("topic_id").isNotNull())
    return answers_of(matched if topic is None else matched.where(F.col("topic_id") == topic))
