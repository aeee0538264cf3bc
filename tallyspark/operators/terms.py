"""Terms of question wordings, and headline candidates made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import hash8
from ..functions.questions import battery_item, clean_generic, is_question_code, question_text, salient_tokens, stopwords
from ..functions.rules import intent_of
from ..functions.stem import stem, stem_of
from ..shared import materialize
from ..functions.text import bind, search_text, title_words

MIN_TERMS, MAX_LABEL_TERMS = 2, 5
#: Tokens that are looked up in tasks, the most frequent first, and the longest of them: what is sent has 50 MB at most.
LOOKED_UP, LONGEST = 100_000, 160
#: Tokens that a worker remembers, and bytes of texts that it reads at once.
REMEMBERED, AT_ONCE = 400_000, 1 << 22
#: Wordings up to which their terms are sent to all tasks.
MOST_WORDINGS = 10_000
#: key, label and the words that mean it.
ALIASES = (
    ("ai", "AI", "ai"), ("covid", "COVID", "covid19 covid coronavirus"), ("sports", "sports", "sport sports"), ("price", "price", "price prices pricing cost costs"),
    ("subscription", "subscription", "subscription subscriptions subscribers"), ("economy", "economy", "economic economics"), ("policy", "policy", "policy policies"),
    ("ukraine", "Ukraine", "ukrainian"), ("israel", "Israel", "israeli"), ("republican", "Republican", "republicans"), ("democrat", "Democrat", "democrats"), ("palestine", "Palestine", "palestinian palestinians"),
    ("immigration", "immigration", "immigration immigrant immigrants migrant migrants border"), ("betting", "betting", "wager wagers wagering gamble gambles gambling bet bets betting"),
    ("regulation", "regulation", "regulate regulates regulated regulating regulation regulations"), ("military-conflict", "military conflict", "strike strikes airstrike airstrikes troop troops war wars military conflict conflicts"),
)
#: pattern and the (key, label) terms that it stands for.
PHRASES = (
    (r"\b(?:artificial intelligence|generative ai|ai)\b", (("ai", "AI"),)),
    (r"\bcost of living\b", (("price", "price"),)),
    (r"\b(?:sports betting|online betting|online wagering)\b", (("sports", "sports"), ("betting", "betting"))),
    (r"\b(?:military action|military strikes?|air strikes?|send troops|ground troops|war)\b", (("military-conflict", "military conflict"),)),
)
INTENT_LABELS = {"attention-focus": "focus", "support-oppose": "support"}


def term(key: str, label: str) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"))


def phrase_terms(text: Column) -> Column:
    """Terms of phrases, in the order of the table."""
    found = [F.when(text.rlike(pattern), F.array(*[term(*t) for t in terms])).otherwise(F.array().cast("array<struct<key:string,label:string>>")) for pattern, terms in PHRASES]
    return F.concat(*found)


def aliased(token: Column) -> Column:
    out = None
    for key, label, tokens in ALIASES:
        hit = token.isin(*tokens.split())
        out = F.when(hit, term(key, label)) if out is None else out.when(hit, term(key, label))
    return out


def display_label(token: Column) -> Column:
    shorter = F.when((F.length(token) > 4) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
    return F.when(token == "policies", "policy").when(token == "companies", "company").when(token == "countries", "country").otherwise(shorter)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """token, n, key and label of each distinct token that is a term, with its number of rows; stemming runs on distinct tokens only."""
    distinct = tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("_alias", aliased(F.col("token")))
    stemmed = distinct.withColumn("_stem", F.when(F.col("_alias").isNull() & (F.length("token") >= 3), stem_of(F.col("token"))))
    usable = (F.length("_stem") >= 3) & ~F.col("_stem").isin(*stopwords())
    named = stemmed.select("token", "n", F.coalesce("_alias.key", F.when(usable, F.col("_stem"))).alias("key"), F.coalesce("_alias.label", display_label(F.col("token"))).alias("label"))
    return named.where("key is not null")


def with_terms(tokens: DataFrame) -> DataFrame:
    """Tokens that are terms, with key and label.

    The most frequent ones, or all where there are no more, are looked up in tasks, so that their rows are not shuffled.
    Of the others none has more than one in LOOKED_UP rows (if it is not over LONGEST characters), and they are joined.
    """
    known = materialize(vocabulary(tokens), "vocabulary")
    short = F.length("token") <= LONGEST
    common = known.where(short).orderBy(F.col("n").desc(), "token").limit(LOOKED_UP).drop("n")
    looked_up = tokens.join(F.broadcast(common), "token")
    if known.count() <= LOOKED_UP and known.where(~short).isEmpty():
        return looked_up
    tokens_left, known_left = (df.join(F.broadcast(common.select("token")), "token", "left_anti") for df in (tokens, known.drop("n")))
    return looked_up.unionByName(tokens_left.join(known_left, "token"))


class TermsOfTexts:
    """Terms of search texts, of many at once, in a worker: each token is looked at once, and remembered.

    Tokens are those of salient_tokens(), and their keys and labels those of vocabulary().
    """

    def __init__(self, stop: tuple[str, ...]) -> None:
        self.stop = frozenset(stop)
        self.aliases = {token: (key, label) for key, label, tokens in reversed(ALIASES) for token in tokens.split()}
        self.known: dict[str, tuple[str, str] | None] = {}

    def _term(self, run: str) -> tuple[str, str] | None:
        """Key and label of the token in a run of letters and digits, which begins with a letter."""
        token = run.lstrip("0123456789")
        if len(token) < 2 or token in self.stop:
            return None
        if any(c in "0123456789" for c in token) and (len(token) <= 16 or token.startswith("tm")):
            return None
        if token in self.aliases:
            return self.aliases[token]
        own = stem(token) if len(token) >= 3 else ""
        if len(own) < 3 or own in self.stop:
            return None
        if token in ("policies", "companies", "countries"):
            return own, token[:-3] + "y"
        return own, token[:-1] if len(token) > 4 and token.endswith("s") and not token.endswith("ss") else token

    def _remembered(self, run: str) -> tuple[str, str] | None:
        if run not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self._term(run)
            if len(run) > LONGEST:
                return found
            self.known[run] = found
        return self.known[run]

    def of(self, texts: pa.Array) -> pa.Array:
        """Terms of each text in the order of the text, the first of each key."""
        runs = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.fill_null(texts, ""), "[^a-z0-9]+", " "))
        owner = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy(zero_copy_only=False))
        coded = runs.flatten().dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        terms = [self._remembered(run) for run in coded.dictionary.to_pylist()]
        keys = pa.array([None if t is None else t[0] for t in terms], pa.string())
        labels = pa.array([None if t is None else t[1] for t in terms], pa.string())
        key = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[number]
        at = np.flatnonzero(key >= 0)
        first = np.sort(at[np.unique(owner[at] * (len(terms) + 1) + key[at], return_index=True)[1]])
        begin = np.searchsorted(owner[first], np.arange(len(texts) + 1)).astype(np.int32)
        of = pa.array(number[first])
        return pa.ListArray.from_arrays(pa.array(begin), pa.StructArray.from_arrays([keys.take(of), labels.take(of)], names=["key", "label"]))


def with_own_terms(texts: DataFrame, text_col: str) -> DataFrame:
    """texts and _own, the terms of each one's words; each text is read on its own, so that no token is shuffled."""
    stop = stopwords()
    schema = T.StructType([*texts.schema.fields, T.StructField("_own", T.ArrayType(T.StructType.fromDDL("key string, label string")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermsOfTexts(stop)
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, terms.of(part.column(place))], names=schema.names)
                at = to

    return texts.mapInArrow(run, schema)


def _of_other_keys(terms: Column, given: Column) -> Column:
    """The terms whose keys are not among those of a few given ones."""
    return bind(F.transform(given, lambda u: u["key"]), lambda keys: F.filter(terms, lambda t: ~F.array_contains(keys, t["key"])))


def distinct_by_key(terms: Column) -> Column:
    """The first term of each key, of few terms."""
    return bind(terms, lambda all_terms: F.filter(all_terms, lambda t, i: F.array_position(F.transform(all_terms, lambda u: u["key"]), t["key"]) == i + 1))


def extract_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, terms (array of key and label), features (sorted keys), signature and intent; texts with under two terms are dropped."""
    parts = lambda focus: bind(search_text(focus), lambda low: F.struct(F.coalesce(search_text(battery_item(focus)), low).alias("search"), intent_of(low).alias("intent")))
    texts = df.select(id_col, bind(clean_generic(F.col(text_col)), parts).alias("_p")).select(id_col, F.col("_p.search").alias("_search"), F.col("_p.intent").alias("intent"))
    phrases = bind(distinct_by_key(phrase_terms(F.col("_search"))), lambda p: F.concat(p, _of_other_keys(F.col("_own"), p)))
    joined = with_own_terms(texts, "_search").withColumn("_terms", phrases)
    label = F.replace(F.col("intent"), F.lit("-"), F.lit(" "))
    for name, own in INTENT_LABELS.items():
        label = F.when(F.col("intent") == name, own).otherwise(label)
    with_intent = F.concat("_terms", F.array(F.struct(F.col("intent").alias("key"), label.alias("label"))))
    terms = F.when((F.size("_terms") == 1) & F.col("intent").isNotNull(), distinct_by_key(with_intent)).otherwise(F.col("_terms"))
    featured = joined.select(id_col, terms.alias("terms"), "intent").withColumn("features", F.sort_array(F.transform("terms", lambda t: t["key"])))
    # texts with too few terms are left out where the table is read: before, the filter would make all terms once more
    return materialize(featured.withColumn("signature", F.array_join("features", " ")), "terms").where(F.size("terms") >= MIN_TERMS)


def wording_terms(df: DataFrame, id_col: str) -> DataFrame:
    """extract_terms() of wordings (_text), which many polls ask again: each is read once, and its terms are joined to those who ask it."""
    wordings = materialize(df.where(F.col("_text").isNotNull()).select("_text").distinct(), "wordings")
    found = extract_terms(wordings, "_text", "_text")
    few = F.broadcast(found) if wordings.count() <= MOST_WORDINGS else found
    return df.join(few, "_text").drop("_text")


def title_term(label: Column) -> Column:
    return F.when(label.isin("AI", "COVID", "U.S."), label).otherwise(title_words(label))


def label_of_terms(terms: Column) -> Column:
    """Label from the first five terms."""
    return F.array_join(F.transform(F.slice(terms, 1, MAX_LABEL_TERMS), lambda t: title_term(t["label"])), " ")


def headline_candidates(df: DataFrame, id_col: str = "obs_id") -> DataFrame:
    """id, topic_id and label of structures that no rule matches; helper rows of one source and texts without terms are left out.

    df: id, source_id, title, prompt, and topic_id (null where no rule matches).
    """
    text = F.concat_ws(" ", "title", "prompt")
    helper = (F.col("source_id") == "ipsos") & F.lower(text).rlike(r"approval5_[12]\.")
    rest = df.where(F.col("topic_id").isNull() & ~helper).select(id_col, text.alias("_text"))
    found = wording_terms(rest, id_col)
    return found.select(id_col, F.concat(F.lit("headline-candidate-"), hash8(F.col("signature"))).alias("topic_id"), label_of_terms(F.col("terms")).alias("topic_label"))


def observation_terms(df: DataFrame, id_col: str = "obs_id") -> DataFrame:
    """Terms of observations: the intent of the answers goes before that of the wording.

    df: id, title, prompt, and answer_text (ids and labels of the answers, joined; may be null).
    """
    text = df.select(id_col, question_text(clean_generic(F.col("title")), clean_generic(F.col("prompt"))).alias("_text"))
    found = wording_terms(text, id_col)
    answered = df.select(id_col, intent_of(search_text(F.col("answer_text"))).alias("_answered"))
    return found.join(answered, id_col).withColumn("intent", F.coalesce("_answered", "intent")).drop("_answered")


__all__ = ["extract_terms", "headline_candidates", "is_question_code", "label_of_terms", "observation_terms", "phrase_terms", "title_term", "vocabulary", "with_terms"]
