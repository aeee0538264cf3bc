"""Personal data with DataFrame functions only: patterns propose spans, checks confirm them, nearby words adjust scores.

Kinds: email, ip, card, phone (the base, kept whatever their score), and iban and ssn, which need a score of
`MIN_SCORE`: an iban must pass mod-97 and have its country's length or a context word near it, an ssn must be a number
that is given out and have a context word near it. Context words are whole words within `CONTEXT_CHARS` characters
before or after a span, outside it; they raise its score.

Patterns of the base that repeat a group are matched in an equal form that Java's engine matches in linear time and
without recursion: a separator that joins two digits, and a dot that joins two labels, is first replaced by a private
character of the same length; then each pattern is a plain run of characters. Spans are in code points, ends exclusive.

Defined results: a null or empty text has no spans; repeated rows are searched each; spans of different kinds may
overlap, those of one kind don't; the column named like the output column is replaced, others stay; an empty table gives an empty table. A very long
text is one value, of which a few copies are held: it is cut at all matches at once, positions are running sums over
runs of `RUN` spans, context comes from the gaps between matches, and `redact` cuts runs of spans out of runs of runs.
So time grows about as the text and the number of its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bind
from .common import fresh_name

#: Private characters that stand for joining separators and dots, and one that stands for these if a text holds them.
JOINT, DOT, OTHER = "\ue000", "\ue001", "\ue002"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
EMAIL = f"(?:(?<![A-Za-z0-9._%+{DOT}-])|\\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"(?<![0-9{JOINT}])[0-9](?:{JOINT}?[0-9]){{13,18}}(?![0-9{JOINT}])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
#: Words near a span that make its kind likelier.
CONTEXT = {
    "email": "e-?mails?|contacts?|write",
    "ip": "ip|address|addresses|hosts?|servers?|login",
    "card": "cards?|visa|mastercard|credit|debit|payments?",
    "phone": "phones?|tel|call|mobile|fax",
    "iban": "iban|accounts?|bank|transfers?|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
}
#: Lengths of IBANs by country; fixed values.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE LT LU XK", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS VA",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS", 27: "FR GR IT MC SM", 28: "AL AZ CY HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
#: Score of a confirmed span without context; a context word adds CONTEXT_BONUS.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.5, "ssn": 0.4}
CONTEXT_BONUS, CONTEXT_CHARS, MIN_SCORE = 0.35, 40, 0.6
SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
#: Spans that are summed up or cut as one run.
RUN = 64


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    marks = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(marks, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 when its rearranged number is divided by 97."""
    turned = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")
    step = lambda rest, c: F.when(c <= "9", (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def runs_of(values: Column, size: int) -> Column:
    """The array in runs of `size` values."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(values, at, F.lit(size)))


def running(values: Column, add, zero: int = 0) -> Column:
    """For each value what `add` makes of all before it, in two levels of runs, so that no long array is copied again and again."""

    def within(own: Column, before: Column) -> Column:
        start = F.struct(before.alias("so_far"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(own, start, lambda done, v: F.struct(add(done["so_far"], v).alias("so_far"), F.concat(done["out"], F.array(done["so_far"])).alias("out")))["out"]

    def by_runs(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(zero), add))
        return bind(within(totals, F.lit(zero)), lambda before: F.flatten(F.transform(runs, lambda r, i: within(r, F.get(before, i)))))

    return bind(values, lambda v: bind(runs_of(v, 4 * RUN), by_runs))


def spans_of(text: Column, pattern: str) -> Column:
    """start, end and text of each match, leftmost first, and CONTEXT_CHARS + 1 characters before and after it.

    Gaps between matches and matches add up to positions. A match and the gap at its side have six characters at least
    but for emails (five), so that those of nine matches hold all context.
    """
    reach = CONTEXT_CHARS + 1  # one more, so that a cut word is not taken for a whole one
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def sized(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda gap, m: F.length(gap) + F.length(m))
        heads, tails = F.transform(x["gaps"], lambda g: F.left(g, F.lit(reach))), F.transform(x["gaps"], lambda g: F.right(g, F.lit(reach)))
        return F.struct(x["found"].alias("found"), F.transform(x["gaps"], F.length).alias("lengths"), heads.alias("heads"), tails.alias("tails"), running(both, lambda a, b: a + b).alias("before"))

    def near(x: Column) -> Column:
        count = F.size(x["found"])
        left = F.zip_with(F.slice(x["tails"], F.lit(1), count), x["found"], lambda gap, m: F.concat(gap, m))
        right = F.zip_with(x["found"], F.slice(x["heads"], F.lit(2), count), lambda m, gap: F.concat(m, gap))
        return F.struct(*[x[c].alias(c) for c in ("found", "lengths", "heads", "tails", "before")], left.alias("left"), right.alias("right"))

    def spans(x: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(x["before"], i) + F.get(x["lengths"], i)
            first = F.greatest(i - 8, F.lit(1))
            before = F.concat(F.array_join(F.slice(x["left"], first, F.greatest(i + 1 - first, F.lit(0))), ""), F.get(x["tails"], i))
            after = F.concat(F.get(x["heads"], i + 1), F.array_join(F.slice(x["right"], i + 2, F.lit(9)), ""))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), F.right(before, F.lit(reach)).alias("before"), F.left(after, F.lit(reach)).alias("after"))

        return F.transform(x["found"], span)

    return bind(bind(bind(parts, sized), near), spans)


def confirmed(kind: str, match: Column) -> Column:
    """Whether a proposed match of a kind passes its check."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(F.right(p, F.lit(3)), F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _judged(kind: str, rank: int, proposed: Column) -> Column:
    """Confirmed spans of one kind with their scores; those of added kinds only with a high one."""

    def judge(x: Column) -> Column:
        near = F.lower(F.concat(x["before"], F.lit("\n"), x["after"])).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{CONTEXT[kind]})(?![\p{{L}}\p{{N}}])")
        score = F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        if kind == "iban":
            number = F.replace(x["match"], F.lit(" "), F.lit(""))
            known = F.lit(False)
            for size, countries in IBAN_LENGTHS.items():
                known = known | ((F.length(number) == size) & F.substring(number, 1, 2).isin(countries.split()))
            score = score + F.when(known, CONTEXT_BONUS).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    judged = F.transform(F.filter(proposed, lambda x: confirmed(kind, x["match"])), judge)
    return judged if kind in BASE_KINDS else F.filter(judged, lambda x: x["score"] >= MIN_SCORE)


def find_personal_data(df: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add an array of struct(start, rank, end, kind, score), sorted by start and then by kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = F.when(text.rlike(f"[{JOINT}{DOT}{OTHER}]"), F.translate(text, JOINT + DOT, OTHER + OTHER)).otherwise(text)
    none = F.array().cast(SPAN)
    clean_name = fresh_name(df, "_clean")
    names = {k: fresh_name(df, f"_{k}") for k in KINDS}
    clean_text = F.col(clean_name)
    has_number = text.rlike("(?:[0-9][ -]?){13}[0-9]")
    proposed = {
        "email": F.when(text.contains("@"), spans_of(F.regexp_replace(clean_text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT), EMAIL)),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), spans_of(clean_text, IP)),
        "card": F.when(has_number, spans_of(F.regexp_replace(clean_text, "(?<=[0-9])[ -](?=[0-9])", JOINT), CARD)),
        "phone": F.when(text.rlike(r"\+[0-9]"), spans_of(clean_text, PHONE)),
        "iban": F.when(text.rlike("(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9 ]"), spans_of(clean_text, IBAN)),
        "ssn": F.when(text.rlike("[0-9]-[0-9]{2}-[0-9]{4}"), spans_of(clean_text, SSN)),
    }
    marked = df.withColumn(clean_name, clean).withColumns({names[k]: F.coalesce(v, none) for k, v in proposed.items()})
    scored = [_judged(kind, rank, F.col(names[kind])) for rank, kind in enumerate(KINDS)]
    any_found = F.greatest(*[F.size(names[k]) for k in KINDS]) > 0
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    found = marked.withColumn(out, F.when(any_found, F.array_sort(F.concat(*scored))).otherwise(empty))
    return found.drop(clean_name, *names.values())


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names them all.

    spans are in order of their starts. Runs of RUN * RUN spans, and then of RUN, are cut out first, so that a span is
    not searched for from the begin of a long text.
    """
    kept = bind(
        F.struct(spans.alias("spans"), running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)).alias("ends")),
        lambda x: F.filter(F.transform(x["spans"], lambda s, i: F.struct(F.get(x["ends"], i).alias("from"), s["start"].alias("start"), F.upper(s["kind"]).alias("kind"))), lambda s: s["start"] >= s["from"]),
    )

    def whole(part: Column, base: Column, own: Column) -> Column:
        """Each span with the text before it; `part` begins at position `base` of the text."""
        return F.array_join(F.transform(own, lambda s: F.concat(F.substring(part, s["from"] - base + 1, s["start"] - s["from"]), F.lit("["), s["kind"], F.lit("]"))), "")

    def by_runs(size: int, inner):
        def cut(part: Column, base: Column, own: Column) -> Column:
            def of_run(run: Column) -> Column:
                first, last = F.get(run, F.lit(0)), F.element_at(run, -1)
                piece = F.substring(part, first["from"] - base + 1, last["start"] - first["from"])
                return bind(F.struct(piece.alias("text"), first["from"].alias("base"), run.alias("own")), lambda x: inner(x["text"], x["base"], x["own"]))

            return F.array_join(F.transform(runs_of(own, size), of_run), "")

        return cut

    three_levels = by_runs(RUN * RUN, by_runs(RUN, whole))
    end = F.array_max(F.transform(spans, lambda x: x["end"]))
    put = bind(F.struct(text.alias("text"), kept.alias("own")), lambda x: three_levels(x["text"], F.lit(0), x["own"]))
    return F.when(F.size(spans) > 0, F.concat(put, F.substring(text, end + 1, F.length(text)))).otherwise(text)
