"""Text, number and date expressions. All are built-in Spark expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Month names and their numbers; the short forms are the first three letters, and "sept".
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def bind(c: Column, body) -> Column:
    """body(value of c), with c standing once in the plan however often the body uses it."""
    return F.transform(F.array(c), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def normalize_text(c: Column) -> Column:
    """Trimmed, with runs of Unicode white space as one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def slug(c: Column) -> Column:
    """ASCII letters and digits in lower case, everything between as one dash."""
    return F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_id(c: Column) -> Column:
    """Slug of a topic id that may be given as a path."""
    return slug(F.regexp_replace(c, "^(?:/api/v1/topics/)*(?:api/v1/topics/)*(?:topics/)*", ""))


def search_text(c: Column) -> Column:
    """Lower case, the country's names as "us" and "don't" as "dont", spacing normalised."""
    low = ascii_lower(c)
    for old, new in (("u.s.", " us "), ("u. s.", " us "), ("united states", " us "), ("don't", " dont "), ("don’t", " dont ")):
        low = F.replace(low, F.lit(old), F.lit(new))
    return normalize_text(low)


def words(c: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def iso_date_text(c: Column) -> Column:
    """The first token like 2026-04-28 among runs of digits and dashes; null if a ten-character token with fewer dashes precedes it."""
    dated = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    tens = F.filter(F.split(c, "[^0-9-]"), lambda t: (F.length(t) == 10) & (t.rlike(dated) | (F.length(F.replace(t, F.lit("-"), F.lit(""))) > 8)))
    first = F.get(tens, F.lit(0))
    return F.when(first.rlike(dated), first)


def month_number(name: Column) -> Column:
    """1 to 12 of a full or short month name, without regard to case and outer punctuation; null if it is none."""
    bare = F.regexp_replace(ascii_lower(name), "^[^a-z]+|[^a-z]+$", "")
    out = F.lit(None).cast("int")
    for i, month in enumerate(MONTHS, start=1):
        out = F.when(bare.isin(month, month[:3], *(["sept"] if i == 9 else [])), i).otherwise(out)
    return out


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where it does not exist."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def _names() -> str:
    return "|".join([*MONTHS, *[m[:3] for m in MONTHS], "sept"])


def blog_date(c: Column) -> Column:
    """Date of a text like "16th Apr 2026"."""
    pattern = rf"(?i)^\s*([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({_names()})\W*\s+([0-9]{{4}})\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    return safe_date(part(3).cast("int"), month_number(part(2)), part(1).cast("int"))


def text_date(c: Column) -> Column:
    """The first date like "April 28, 2026" in a text."""
    pattern = rf"(?i)(?:^|\s)[^\w\s]*({_names()})[^\w\s]*\s+[^\w\s]*([0-9]{{1,2}})[^\w\s]*\s+[^\w\s]*([0-9]{{4}})(?![0-9])"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    return safe_date(part(3).cast("int"), month_number(part(1)), part(2).cast("int"))


def years_prior(d: Column, n: int) -> Column:
    return F.add_months(d, -12 * n)


def cutoff_date(today: Column, unit: str, n: int) -> Column:
    """First day of a scope of n days, weeks, months or years; days that a month lacks become its last."""
    steps = {"days": lambda: F.date_sub(today, n), "weeks": lambda: F.date_sub(today, 7 * n), "months": lambda: F.add_months(today, -n), "years": lambda: years_prior(today, n)}
    return steps[unit]()


def chart_number(c: Column) -> Column:
    """Number of a chart cell: without percent signs, commas and "<"; null for "-", "n/a" and blank."""
    bare = F.trim(F.translate(c, "%,<", ""))
    return F.when(~ascii_lower(bare).isin("", "-", "n/a"), bare.try_cast("double"))


def topline_number(c: Column) -> Column:
    """Number of a topline token: "*", "-" and "n/a" are 0; null for other text."""
    bare = F.trim(F.translate(c, "%,<", ""))
    return F.when(ascii_lower(bare).isin("*", "-", "n/a"), F.lit(0.0)).otherwise(F.when(bare != "", bare.try_cast("double")))


def percentage(c: Column) -> Column:
    """Number before a percent sign; null without one."""
    return F.when(c.endswith("%"), F.regexp_replace(c, "%+$", "").try_cast("double"))


def scale_percent(v: Column) -> Column:
    """Shares up to 1.5 as percentages."""
    return F.when(F.abs(v) <= 1.5, v * 100).otherwise(v)


def row_label(c: Column, k: int) -> Column:
    """What stands before the last k tokens of a line."""
    w = words(c)
    return F.when(F.size(w) > k, F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - k, F.lit(0))), " "))


def row_values(c: Column, k: int) -> Column:
    """The last k tokens of a line as numbers; null unless all are."""
    numbers = F.transform(F.slice(words(c), F.lit(-k), F.lit(k)), topline_number)
    return F.when((F.size(words(c)) > k) & F.forall(numbers, lambda v: v.isNotNull()), numbers)


def strip_leading_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^[0-9]+[a-zA-Z]?\.\s*", "")


def strip_selected_choice(c: Column) -> Column:
    return F.regexp_replace(c, r" - Selected Choice\s*$", "")


def title_prefix(title: Column) -> Column:
    """What stands before the first colon; nothing without one."""
    return F.when(F.instr(title, ":") > 0, F.trim(F.substring_index(title, ":", 1))).otherwise("")


def base_question(title: Column, prompt: Column) -> Column:
    """The prompt, else what follows the first colon of the title, without a leading number."""
    after = F.when(F.instr(title, ":") > 0, F.trim(F.substring(title, F.instr(title, ":") + 1, F.length(title)))).otherwise(title)
    own = F.trim(F.coalesce(prompt, F.lit("")))
    return strip_leading_number(F.when(own != "", own).otherwise(after))


def title_words(c: Column) -> Column:
    """Parts between dashes, each with a capital first letter."""
    parts = F.filter(F.split(c, "-"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), " ")


def label_from_topic_id(c: Column) -> Column:
    """Title of a topic id: without "headline-", AI, US and UK in capitals."""
    parts = F.filter(F.split(F.regexp_replace(c, "^headline-", ""), "-"), lambda p: p != "")
    one = lambda p: F.when(p.isin("ai", "us", "uk"), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20)))
    return F.array_join(F.transform(parts, one), " ")
