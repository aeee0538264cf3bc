"""Question wording: cleaning, battery items, and the text that fingerprints and clusters look at."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from .rules import any_of
from .text import ascii_lower, bind, normalize_text, search_text, trim_space, words

#: Fixed patterns of question codes and of what polls put before a question.
CODE = r"(?i)(?:^|[:\s])(?:[a-z][a-z0-9_-]{0,24}|[0-9]{1,3}[a-z]?)\.\s+"
LEADING_CODE = r"(?i)^(?:[a-z][a-z0-9_-]{0,24}|[0-9]{1,3}[a-z]?)\.\s+"
DATED_PREFIX = r"(?i)^[0-9]{4}-[0-9]{2}-[0-9]{2}:\s+[^:]{3,240}:\s+(.+)$"
SURVEY_PREFIX = r"(?i)^[a-z]+ [0-9]{1,2}\s*-\s*[0-9]{1,2},\s*[0-9]{4}\s*-\s*[0-9,]+\s+u\.s\. adult citizens:\s+(.+)$"
TOKEN = "[a-z][a-z0-9]+"
#: Headings under which a list of items is asked about.
BATTERY_HEADINGS = ("approval on issues", "favorability of", "following issues", "following things", "these public figures", "towards these public figures", "where you live")
#: Words of polling that say nothing about a subject; Spark ML's English list is added to them.
POLLING_STOPWORDS = tuple(
    "adult adults action american americans answer approve asked believe candidate citizen citizens country current direction disapprove doing dont election feel following generally heading important increase increasingly ipsos issue issues "
    "january february march april may june july august september october november december latest less more most overall oppose opposed ballot held primary vote voted poll polling polls question right reuter reuters respond respondent respondents "
    "say saying speaking somewhat strong strongly support survey thing things think time today total track trump views voter voters washington wrong worth".split()
)


@lru_cache(maxsize=1)
def stopwords() -> tuple[str, ...]:
    """Polling words and the English stop words that Spark ML comes with."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(sorted({*POLLING_STOPWORDS, *StopWordsRemover.loadDefaultStopWords("english")}))


def is_question_code(token: Column) -> Column:
    """Letters and digits in one short token, or one that starts with "tm"."""
    return token.rlike("[0-9]") & token.rlike("[a-z]") & ((F.length(token) <= 16) | token.startswith("tm"))


def strip_leading_code(c: Column) -> Column:
    return trim_space(F.regexp_replace(F.regexp_replace(c, r"(?U)^[:\s]+", ""), LEADING_CODE, ""))


def _without_metadata(c: Column) -> Column:
    cut = lambda pattern: lambda t: F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 1))).otherwise(t)
    return bind(bind(c, cut(SURVEY_PREFIX)), cut(DATED_PREFIX))


def _from_code(text: Column, other: Column) -> Column:
    return F.when(text.rlike(CODE), strip_leading_code(F.substring(text, F.regexp_instr(text, F.lit(CODE)), F.length(text)))).otherwise(other)


def _cleaned(text: Column, by_colon: bool) -> Column:
    tail = F.substring_index(text, ":", -1)
    rest = F.when((F.instr(text, ":") > 0) & (F.size(words(tail)) >= 2), tail).otherwise(text) if by_colon else text
    return _from_code(text, bind(_without_metadata(text), lambda bare: strip_leading_code(F.when(bare != text, bare).otherwise(rest))))


def clean_generic(c: Column) -> Column:
    """From the first question code on; else without dated prefixes; else what follows the last colon; without leading code."""
    return bind(normalize_text(c), lambda text: _cleaned(text, True))


def clean_for_source(source: Column, c: Column) -> Column:
    """The two sources with metadata in their titles are cut; the others only lose a leading code."""
    return bind(normalize_text(c), lambda text: F.when(source.isin("ipsos", "yougov"), _cleaned(text, False)).otherwise(strip_leading_code(text)))


def question_key(c: Column) -> Column:
    return search_text(clean_generic(c))


def salient_tokens(search: Column) -> Column:
    """Tokens of a search text that are neither stop words nor codes."""
    return F.filter(F.regexp_extract_all(search, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*stopwords()) & ~is_question_code(t))


def battery_item(c: Column) -> Column:
    """The item of a list question: what follows the last "?", or a dash after a heading; null if there is none."""

    def item(tail: Column) -> Column:
        fits = lambda low: (F.size(words(low)) <= 10) & (F.size(salient_tokens(low)) >= 1)
        bare = F.regexp_replace(tail, r"(?U)^[\s:–—-]+|[\s:–—-]+$", "")
        return bind(bare, lambda b: F.when(bind(search_text(b), fits) & ~b.contains("?"), b))

    def after(text: Column, mark: str) -> Column:
        tail = F.substring_index(text, mark, -1)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail) - len(mark))
        return F.when((F.instr(text, mark) > 0) & bind(search_text(head), lambda h: any_of(h, BATTERY_HEADINGS)), item(tail))

    return bind(c, lambda text: F.coalesce(F.when(F.instr(text, "?") > 0, item(F.substring_index(text, "?", -1))), after(text, "—"), after(text, "–"), after(text, " - ")))


def _same(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def _joined(title: Column, prompt: Column) -> Column:
    return F.when((prompt == "") | _same(title, prompt) | F.contains(title, prompt), title).when(title == "", prompt).otherwise(F.concat(title, F.lit(": "), prompt))


def _pair(title: Column, prompt: Column, body) -> Column:
    return bind(F.struct(title.alias("title"), prompt.alias("prompt")), lambda x: body(x["title"], x["prompt"]))


def question_text(title: Column, prompt: Column) -> Column:
    """Wording of an observation for clustering; title and prompt are cleaned already."""

    def body(t: Column, p: Column) -> Column:
        return bind(battery_item(t), lambda item: F.when(item.isNotNull() & (p != "") & ~_same(t, p), F.concat(p, F.lit(" "), item)).otherwise(_joined(t, p)))

    return _pair(title, prompt, body)


def fingerprint_text(title: Column, prompt: Column) -> Column:
    """Wording of an observation for its fingerprint."""
    return _pair(trim_space(F.coalesce(title, F.lit(""))), trim_space(F.coalesce(prompt, F.lit(""))), _joined)
