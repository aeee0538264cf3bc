"""Topline text: line kinds as expressions, and the two table layouts, one document at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import ascii_lower, normalize_text, words

#: Fixed lines of page furniture (without regard to ASCII case), and banners that are cut out of lines.
NOISE = ("TOPLINE & METHODOLOGY", "2020 K Street, NW, Suite 410", "Washington DC 20006", "+1 202 463-7300", "Contact:", "Email:", "Annotated Questionnaire")
BANNERS = ("TOPLINE & METHODOLOGY", "Annotated Questionnaire")
RESPONDENTS = "Respondents"
QUESTION = r"^[A-Z][A-Za-z0-9_-]{0,24}\. \S|^[0-9]{1,3}[A-Za-z]?\. \S"
CONTENTS = r"\.\s*\.\s*\."
SIZE = r"\(?N\s*=\s*([0-9,]+)\)?"
#: Cells, or rows of a panel, that a worker holds before it hands them on; one document's stay together.
CELLS_AT_ONCE = 10_000
LOOK_AHEAD, SIZE_WITHIN, LABEL_LINES, TEMPLATE_WITHIN = 24, 12, 4, 20
#: Titles, and fixed lines of page furniture, of the layout with fixed templates.
NUMBERED, DOCUMENT_TITLE, SAMPLE = r"[0-9]+[A-Z]?\. ", "The Economist/YouGov Poll", "U.S. Adult Citizens"
#: Panel headers and their columns and groups, of the layout with fixed templates.
TEMPLATES = (
    ("Sex Race Age Education", ("Total", "Male", "Female", "White", "Black", "Hispanic", "18-29", "30-44", "45-64", "65+", "No degree", "College grad"), (("Sex", 2), ("Race", 3), ("Age", 4), ("Education", 2))),
    ("2024 Vote Reg Ideology MAGA Party ID", ("Total", "Harris", "Trump", "Voters", "Lib", "Mod", "Con", "Supporter", "Dem", "Ind", "Rep"), (("2024 Vote", 2), ("Reg", 1), ("Ideology", 3), ("MAGA", 1), ("Party ID", 3))),
)
ROWS = "question string, prompt string, panel int, row_idx int, row_label string, column_labels array<string>, group_titles array<string>, values array<double>"
#: The same by header, with the line of column names and the title of each column's group.
TEMPLATE_OF = {head: (" ".join(columns), columns, (None, *(title for title, n in groups for _ in range(n)))) for head, columns, groups in TEMPLATES}


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no and line, without banners and with spacing normalised."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "_line")).select(id_col, "line_no", clean_line(F.col("_line")).alias("line"))


def clean_line(line: Column) -> Column:
    for banner in BANNERS:
        line = F.replace(line, F.lit(banner), F.lit(""))
    return normalize_text(line)


def is_noise(line: Column) -> Column:
    """Blank, digits alone, or a fixed line of page furniture."""
    return (line == "") | line.rlike("^[0-9]+$") | ascii_lower(line).isin(*[n.lower() for n in NOISE])


def is_page_number(line: Column) -> Column:
    return line.rlike("^[0-9]{1,4}$") | line.rlike(r"(?i)^page [0-9]+( of [0-9]+)?$")


def is_question_title(line: Column) -> Column:
    """A code or number, a dot, and text; dot leaders are lines of contents."""
    return line.rlike(QUESTION) & ~line.rlike(CONTENTS) & (F.size(words(line)) >= 3)


def line_kind(line: Column) -> Column:
    return F.when(line == "", "blank").when(is_page_number(line), "page").when(is_noise(line), "noise").when(line.rlike(CONTENTS), "contents").when(is_question_title(line), "question").when(line.rlike(f"^{SIZE}$"), "size").when(line.rlike(r"\s(?:[0-9]+%?|\*|-)$"), "row").otherwise("text")


@lru_cache(maxsize=100_000)
def _number(token: str) -> float | None:
    bare = token.strip("%<").replace(",", "")
    if bare.lower() in ("*", "-", "n/a", "") and token:
        return 0.0
    return float(bare) if re.fullmatch(r"\d+(?:\.\d+)?", bare) else None


def _row(line: str, k: int) -> tuple[str, list[float]] | None:
    """Label and the last k numbers of a line."""
    tokens = line.split()
    values = [_number(t) for t in tokens[-k:]]
    if len(tokens) <= k or any(v is None for v in values):
        return None
    return " ".join(tokens[:-k]), values


def _without_banners(line: str) -> str:
    for banner in BANNERS:
        line = line.replace(banner, "")
    return line


def _kind(line: str) -> str:
    if not line or (line.isascii() and line.isdigit()) or line.lower() in {n.lower() for n in NOISE} or re.search(CONTENTS, line):
        return "skip"
    return "question" if re.match(QUESTION, line) and len(line.split()) >= 3 else "text"


def _column_labels(lines: list[str], at: int) -> tuple[list[str], int]:
    """Labels, each of up to LABEL_LINES lines and closed by its sample size, and the line after them."""
    labels, part = [], []
    while at < len(lines):
        line = lines[at]
        size = re.search(r"\(\s*N\s*=\s*[\d,]+\s*\)", line)
        if not size and (len(part) >= LABEL_LINES or _kind(line) == "question" or re.search(r"\s(?:\d+%?|\*|-)$", line)):
            break
        if size:
            part.append(line[: size.start()].strip())
            labels.append(" ".join(p for p in part if p))
            part = []
        elif _kind(line) != "skip":
            part.append(line)
        at += 1
    return labels, at - len(part)


def cells_of(rows: Iterable[tuple]) -> list[tuple]:
    return [(*row, c, label, title, value) for *row, labels, titles, values in rows for c, (label, title, value) in enumerate(zip(labels, titles, values))]


def rows_by_headers(lines: list[str]) -> list[tuple]:
    """Rows of questions whose column headers carry sample sizes."""
    out, i = [], 0
    while i < len(lines):
        if _kind(lines[i]) != "question":
            i += 1
            continue
        question = lines[i]
        head = next((j for j in range(i + 1, min(i + 1 + LOOK_AHEAD, len(lines))) if lines[j].startswith("Total") and any(re.search(r"N\s*=", x) for x in lines[j : j + SIZE_WITHIN])), None)
        if head is None or any(_kind(x) == "question" for x in lines[i + 1 : head]):
            i += 1
            continue
        labels, at = _column_labels(lines, head)
        wording = " ".join([question, *(x for x in lines[i + 1 : head] if _kind(x) != "skip")])
        row, pending = 0, []
        while at < len(lines) and labels and _kind(lines[at]) != "question":
            if _kind(lines[at]) == "text":
                pending.append(lines[at])
                found = _row(" ".join(pending), len(labels))
                if found:
                    if found[0] and found[0].lower() != "total":
                        out.append((wording, "", 0, row, found[0], labels, [RESPONDENTS] * len(labels), found[1]))
                        row += 1
                    pending = []
            at += 1
        i = max(at, i + 1)
    return out


class _TemplateDocument:
    """Reads lines one by one: a title waits for its first panel and gathers a prompt, then panels follow until the next title.

    Page furniture (blank lines, page numbers, the document's title, the line of the sample) is passed over in and
    between panels, so that a page break cuts neither a panel nor a label of several lines. A title that no panel
    follows within TEMPLATE_WITHIN lines, or before the document's title or another one, is no question.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.title: str | None = None
        self.ahead: list[str] = []
        self.prompt = ""
        self.panel = self.row = 0
        self.template: tuple | None = None
        self.pending: list[str] = []
        self.panels = 0

    def _begin(self, title: str) -> None:
        self.title, self.ahead, self.panels, self.template, self.pending = title, [], 0, None, []

    def _open(self, template: tuple) -> None:
        if not self.panels:
            self.prompt = " ".join(line for line in self.ahead if line and not _is_digits(line))
        self.template, self.panel, self.row, self.pending = template, self.panels, 0, []
        self.panels += 1

    def _wait(self, line: str) -> list[str]:
        """A line between a title and its first panel; the lines to read again if the title turns out to be none."""
        self.ahead.append(line)
        if line == DOCUMENT_TITLE or len(self.ahead) >= TEMPLATE_WITHIN - 1 or (len(self.ahead) > 1 and _is_numbered_title(line)):
            self.title = None
            return self.ahead
        return []

    def _read_row(self, line: str) -> None:
        names, columns, titles = self.template
        if line == names:
            return
        self.pending.append(line)
        found = _percentages(" ".join(self.pending), len(columns))
        if found:
            self.rows.append((self.title, self.prompt, self.panel, self.row, found[0], columns, titles, found[1]))
            self.row, self.pending = self.row + 1, []

    def read(self, line: str) -> None:
        template = TEMPLATE_OF.get(line)
        if self.title is not None and template:
            self._open(template)
        elif self.title is not None and not self.panels:
            for skipped in self._wait(line):
                self.read(skipped)
        elif _is_numbered_title(line):
            self._begin(line)
        elif self.template and not _is_furniture(line):
            if line.startswith("Totals "):
                self.template = None
            else:
                self._read_row(line)


def _is_digits(line: str) -> bool:
    return line.isascii() and line.isdigit()


def _is_numbered_title(line: str) -> bool:
    return "0" <= line[:1] <= "9" and bool(re.match(NUMBERED, line)) and not re.search(CONTENTS, line)


def _is_furniture(line: str) -> bool:
    return not line or _is_digits(line) or line == DOCUMENT_TITLE or SAMPLE in line


def _percentages(line: str, k: int) -> tuple[str, list[float]] | None:
    """Label and exactly k percentages at the end of a line."""
    tokens = line.split()
    if len(tokens) <= k or tokens[-k - 1].endswith("%"):
        return None
    last = tokens[-k:]
    if not all([t[-1] == "%" or t == "*" or t == "-" for t in last]):
        return None
    values = [_number(t) for t in last]
    return None if None in values else (" ".join(tokens[:-k]), values)


def rows_by_templates(lines: list[str]) -> list[tuple]:
    """Rows of questions whose panels have one of the fixed headers; a line of column names below a header may be missing."""
    document = _TemplateDocument()
    for line in lines:
        document.read(line)
    return document.rows


def parse_by_headers(lines: list[str]) -> list[tuple]:
    return cells_of(rows_by_headers(lines))


def parse_by_templates(lines: list[str]) -> list[tuple]:
    return cells_of(rows_by_templates(lines))


def cell_frames(batches: Iterable[pd.DataFrame], parse: Callable, names: list[str]) -> Iterator[pd.DataFrame]:
    """Cells (or rows) of documents, some CELLS_AT_ONCE at a time, whatever the size of a batch of documents."""
    rows: list[tuple] = []
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            lines = [" ".join(x.split()) for x in _without_banners(text or "").split("\n")]
            rows += [(doc_id, *r) for r in parse(lines)]
            if len(rows) >= CELLS_AT_ONCE:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    yield pd.DataFrame(rows, columns=names)


def topline_rows(docs: DataFrame, layout: str = "headers") -> DataFrame:
    """Rows of the panels of each document's questions, with doc_id as it comes; a document is parsed on its own, so that nothing is shuffled.

    With "headers" the wording holds the prompt; with "templates" it is a column of its own. What a worker hands on is a
    row with its columns, not each cell.
    """
    parse: Callable = {"headers": rows_by_headers, "templates": rows_by_templates}[layout]
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(ROWS).fields])
    names = schema.names

    return docs.select("doc_id", "text").mapInPandas(lambda batches: cell_frames(batches, parse, names), schema)


def topline_cells(docs: DataFrame, layout: str = "headers") -> DataFrame:
    """Cells of the same rows."""
    cells = F.posexplode(F.arrays_zip("column_labels", "group_titles", "values")).alias("col_idx", "_c")
    rows = topline_rows(docs, layout).select("doc_id", "question", "prompt", "panel", "row_idx", "row_label", cells)
    return rows.select("doc_id", "question", "prompt", "panel", "row_idx", "row_label", "col_idx", F.col("_c.column_labels").alias("column_label"), F.col("_c.group_titles").alias("group_title"), F.col("_c.values").alias("value"))


def document_header(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, title and subtitle from a table of lines: the first two that are neither blank nor page numbers."""
    usable = lines.where((F.col("line") != "") & ~is_page_number(F.col("line")))
    place = Window.partitionBy(id_col).orderBy("line_no")
    first = usable.withColumn("_r", F.row_number().over(place)).where("_r <= 2")
    return first.groupBy(id_col).agg(F.min_by("line", "line_no").alias("title"), F.max(F.when(F.col("_r") == 2, F.col("line"))).alias("subtitle"))


def document_titles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, title and subtitle of whole texts, without a shuffle: the first two lines that are neither blank nor page numbers; documents without any are left out."""
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), clean_line)
    first = F.slice(F.filter(lines, lambda x: (x != "") & ~is_page_number(x)), 1, 2)
    return docs.select(id_col, first.alias("_first")).where(F.size("_first") > 0).select(id_col, F.col("_first")[0].alias("title"), F.get("_first", F.lit(1)).alias("subtitle"))


def prefix_question(date: Column, title: Column, question: Column) -> Column:
    """Title of a structure with the identity of its poll."""
    return F.concat_ws(": ", F.coalesce(date.cast("string"), F.lit("Unknown Date")), title, question)


def with_fallback(docs: DataFrame, parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, type and text: documents from which nothing was parsed stay as unstructured ones."""
    kept = parsed.select(id_col).distinct()
    tables = kept.select(id_col, F.lit("Crosstab").alias("type"), F.lit(None).cast("string").alias("data"))
    rest = docs.join(kept, id_col, "left_anti").select(id_col, F.lit("Unstructured").alias("type"), F.col("text").alias("data"))
    return tables.unionByName(rest)
