"""Rule tables for topics, answers, demographics and intents, as one conditional expression each.

The tables are fixed values of the poll vocabulary; the order of the rules decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import ascii_lower, bind, normalize_text, search_text, slug

#: Stable topics: id and label.
CATALOG = (
    ("presidential-approval", "Presidential approval"),
    ("right-direction", "Right direction / wrong track"),
    ("generic-ballot", "Generic congressional ballot"),
    ("important-problem", "Most important problem"),
    ("economy-approval", "Economy approval"),
    ("inflation-approval", "Inflation and cost of living approval"),
    ("immigration-approval", "Immigration approval"),
    ("foreign-policy-approval", "Foreign policy approval"),
    ("trump-favorability", "Donald Trump favorability"),
)
APPROVAL_TOPICS = ("presidential-approval", "economy-approval", "inflation-approval", "immigration-approval", "foreign-policy-approval")
EXACT, EQUIVALENT, ROLLUP, TREND = "exact_wording", "equivalent_wording", "rollup_compatible", "trend_comparable"
NO_MATCH = "-"
#: (topic, compatibility, all of these groups of which one must occur, none of these)
GENERIC_TOPICS = (
    ("presidential-approval", EQUIVALENT, (("approve or disapprove", "approval", "job performance"), ("president", "donald trump", "trump approval")), ("issue?", "approval on issues", "handling the u.s. economy", "handling immigration", "handling the following issues", "handling the following things", "handling the situation in iran")),
    ("right-direction", EXACT, (("right direction",), ("wrong track",)), ()),
    ("generic-ballot", EQUIVALENT, (("u.s. congress", "congressional", "generic ballot"), ("democratic",), ("republican",)), ()),
    ("important-problem", EQUIVALENT, (("most important problem", "main problem facing"),), ()),
    ("economy-approval", EQUIVALENT, (("handling the u.s. economy", "handling the economy", "u.s. economy"),), ()),
    ("inflation-approval", EQUIVALENT, (("inflation", "rising prices", "cost of living"),), ()),
    ("immigration-approval", EQUIVALENT, (("immigration",), ("approve", "handling")), ()),
    ("foreign-policy-approval", EQUIVALENT, (("foreign policy",), ("approve", "handling")), ()),
    ("trump-favorability", EQUIVALENT, (("donald trump",), ("favorable",), ("unfavorable",)), ()),
)
SOURCE_TOPICS = {
    "gallup": (("presidential-approval", TREND, (("president",), ("approval",)), ()),),
    "yougov": (
        ("right-direction", EXACT, (("direction of country",),), ()),
        ("right-direction", EXACT, (("right direction",), ("wrong track",)), ()),
        ("presidential-approval", EQUIVALENT, (("trump approval", "donald trump approval"),), ("approval on issues", "trump approval -", "handling the following things")),
    ),
    "ipsos": (
        ("presidential-approval", EXACT, (("approval5_sum.",),), ()),
        (NO_MATCH, NO_MATCH, (("approval5_1.", "approval5_2."),), ()),
        ("important-problem", EXACT, (("cp1.",),), ()),
        ("right-direction", EXACT, (("cp2.",),), ()),
        (NO_MATCH, NO_MATCH, (("generally speaking, would you say the following things",),), ()),
        ("generic-ballot", EXACT, (("tm3287y24.",),), ()),
        ("economy-approval", EXACT, (("tm1128y17_1.",),), ()),
        ("inflation-approval", EXACT, (("tm1128y17_8.", "handling inflation"),), ()),
        ("immigration-approval", EXACT, (("tm1128y17_7.",),), ()),
        ("foreign-policy-approval", EXACT, (("tm1128y17_25.",),), ()),
        ("trump-favorability", EXACT, (("tm3154y23_1.",), ("donald trump",)), ()),
    ),
}
#: Group id and the titles that mean it.
GROUPS = (
    ("gender", ("sex", "gender")), ("race", ("race", "race/ethnicity", "race/hispanic ethnicity")), ("age", ("age",)), ("education", ("education",)),
    ("party-id", ("party", "party id", "political party")), ("vote-2024", ("2024 vote",)), ("ideology", ("ideology",)), ("maga", ("maga",)), ("registration", ("reg", "registration")),
)
#: Demographic id, labels that mean it in any group, labels that mean it in the named group only.
DEMOGRAPHICS = (
    ("total", ("total", "all adults", "all respondents"), None, ()),
    ("registered-voters", ("registered voters",), "registration", ("voters",)),
    ("party-democrat", ("democrat",), "party-id", ("dem", "democratic")),
    ("party-republican", ("republican",), "party-id", ("rep",)),
    ("party-independent", ("independent", "independent/something else"), "party-id", ("ind",)),
    ("vote-2024-harris", (), "vote-2024", ("harris",)),
    ("vote-2024-trump", (), "vote-2024", ("trump",)),
    ("gender-male", ("male",), None, ()),
    ("gender-female", ("female",), None, ()),
    ("race-white", ("white",), None, ()),
    ("race-black", ("black",), None, ()),
    ("race-hispanic", ("hispanic",), None, ()),
    ("age-18-29", ("18-29",), None, ()),
    ("age-30-44", ("30-44",), None, ()),
    ("age-45-59", ("45-59",), None, ()),
    ("age-45-64", ("45-64",), None, ()),
    ("age-60-plus", ("60+",), None, ()),
    ("age-65-plus", ("65+",), None, ()),
    ("education-no-degree", ("no degree",), None, ()),
    ("education-college-grad", ("college grad",), "education", ("college graduate",)),
    ("ideology-liberal", (), "ideology", ("lib", "liberal")),
    ("ideology-moderate", (), "ideology", ("mod", "moderate")),
    ("ideology-conservative", (), "ideology", ("con", "conservative")),
    ("maga-supporter", (), "maga", ("supporter",)),
)
#: Text that shows what a question asks about, in order.
INTENT_NEEDLES = (
    ("awareness", ("heard about", "have you heard")), ("attention-focus", ("focus on", "focused on")), ("future-effect", ("over the long run", "get better or worse", "will get", " will...", "will make")),
    ("impact", ("had an impact", "impact on", " impact ")), ("local-condition", ("where you live",)), ("worth-it", ("worth it", "not worth")), ("vote-choice", ("vote for", "would you vote")),
)


def catalog_table(spark: SparkSession) -> DataFrame:
    """topic_id, catalog_label and catalog_rank of the stable topics."""
    return spark.createDataFrame([(i, label, k) for k, (i, label) in enumerate(CATALOG)], "topic_id string, catalog_label string, catalog_rank int")


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def _rule_number(text: Column, rules: tuple, first: int) -> Column:
    """Number of the first rule that fits, counted from `first`; null if none does."""
    out = None
    for n, (_, _, needed, barred) in enumerate(rules, start=first):
        hit = reduce(lambda a, b: a & b, [any_of(text, group) for group in needed])
        if barred:
            hit = hit & ~any_of(text, barred)
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out


def topic_match(source: Column, lower_text: Column) -> Column:
    """struct(topic_id, compatibility), both null for no match. lower_text: title and prompt, normalised and in lower case.

    Rules have numbers, so that the long condition stands once in the plan.
    """
    rules = [*GENERIC_TOPICS, *(r for own in SOURCE_TOPICS.values() for r in own)]

    def number(x: Column) -> Column:
        found, first = [], len(GENERIC_TOPICS) + 1
        for name, own in SOURCE_TOPICS.items():
            found.append(F.when(x["source"] == name, _rule_number(x["text"], own, first)))
            first += len(own)
        return F.coalesce(*found, _rule_number(x["text"], GENERIC_TOPICS, 1))

    n = bind(F.struct(source.alias("source"), lower_text.alias("text")), number)
    named = lambda k: F.map_from_arrays(F.array(*[F.lit(i + 1) for i, r in enumerate(rules) if r[0] != NO_MATCH]), F.array(*[F.lit(r[k]) for r in rules if r[0] != NO_MATCH]))
    return bind(n, lambda x: F.struct(F.element_at(named(0), x).alias("topic_id"), F.element_at(named(1), x).alias("compatibility")))


def structure_text(title: Column, prompt: Column) -> Column:
    """The text that topic rules look at."""
    return ascii_lower(normalize_text(F.concat_ws(" ", title, prompt)))


def _answer(i: str, label: str, priority: int | Column = 3) -> Column:
    return F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), (F.lit(priority) if isinstance(priority, int) else priority).cast("int").alias("priority"))


def _unsure(low: Column) -> Column:
    return F.when(any_of(low, ("don't know", "dont know", "not sure", "unsure")), _answer("unsure", "Unsure")).when(low.contains("skipped"), _answer("skipped", "Skipped"))


def _net(low: Column, root: str) -> Column:
    return F.when(low.contains("(net)") | low.contains(" net") | (low == root), 3).otherwise(1)


def answer_of(topic: Column, label: Column) -> Column:
    """struct(id, label, priority): the canonical answer of a label; components of a sum have priority 1.

    Topics with rules of their own look at these and then at what means "unsure"; what is left goes to the general ones.
    """
    return bind(F.struct(topic.alias("topic"), normalize_text(label).alias("text")), lambda x: _answer_of(x["topic"], x["text"]))


def _answer_of(topic: Column, text: Column) -> Column:
    low = ascii_lower(text)
    plain = F.struct(F.when(topic == "important-problem", F.concat(F.lit("issue-"), slug(text))).otherwise(slug(text)).alias("id"), text.alias("label"), F.lit(3).alias("priority"))
    roots = lambda *pairs: reduce(lambda done, r: done.when(low.contains(r[0]), _answer(r[0], r[1], _net(low, r[0]))), pairs[1:], F.when(low.contains(pairs[0][0]), _answer(pairs[0][0], pairs[0][1], _net(low, pairs[0][0]))))
    own = (
        F.when(topic.isin(*APPROVAL_TOPICS), roots(("disapprove", "Disapprove"), ("approve", "Approve")))
        .when(topic == "trump-favorability", roots(("unfavorable", "Unfavorable"), ("favorable", "Favorable")).when(low.contains("not heard"), _answer("not-heard-of", "Have not heard of them")))
        .when(topic == "right-direction", F.when(low.contains("right direction"), _answer("right-direction", "Right direction")).when(low.contains("wrong track"), _answer("wrong-track", "Wrong track")))
        .when(
            topic == "generic-ballot",
            F.when(low.contains("democratic") | (low == "democrat"), _answer("democratic-candidate", "Democratic candidate"))
            .when(low.contains("republican"), _answer("republican-candidate", "Republican candidate"))
            .when(any_of(low, ("another", "third")), _answer("another-candidate", "Another candidate"))
            .when(any_of(low, ("will not", "do not plan")), _answer("will-not-vote", "Will not vote")),
        )
    )
    special = topic.isin(*APPROVAL_TOPICS, "trump-favorability", "right-direction", "generic-ballot")
    generic = F.when(low.contains("support") & ~low.contains("oppose"), _answer("support", "Support")).when(low.contains("oppose"), _answer("oppose", "Oppose")).when(low.contains("not worth"), _answer("not-worth-it", "Not worth it")).when(low.contains("worth it"), _answer("worth-it", "Worth it"))
    return F.coalesce(own, F.when(special, _unsure(low)), generic, _unsure(low), plain)


def group_id(title: Column) -> Column:
    """Id of a demographic group; null for a blank title."""
    text = normalize_text(title)
    low = ascii_lower(text)
    out = F.when(low == "", F.lit(None).cast("string"))
    for i, titles in GROUPS:
        out = out.when(low.isin(*titles), i)
    return out.otherwise(slug(text))


def demographic_of(label: Column, group_title: Column) -> Column:
    """struct(id, label, group_id, group_label) of a column label in its group."""
    return bind(F.struct(normalize_text(label).alias("text"), group_id(group_title).alias("group"), normalize_text(group_title).alias("title")), _demographic_of)


def _demographic_of(x: Column) -> Column:
    low, group, out = ascii_lower(x["text"]), x["group"], None
    for i, anywhere, own_group, own in DEMOGRAPHICS:
        hit = low.isin(*anywhere) if anywhere else F.lit(False)
        if own:
            hit = hit | ((group == own_group) & low.isin(*own))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    named = out.otherwise(F.concat(F.lit("custom-"), slug(x["text"])))
    return F.struct(named.alias("id"), x["text"].alias("label"), group.alias("group_id"), F.when(group.isNotNull(), x["title"]).alias("group_label"))


def intent_of(text: Column) -> Column:
    """What a question asks about, by its search text; null if nothing shows it."""
    return bind(text, _intent_of)


def _intent_of(low: Column) -> Column:
    both = lambda a, b: low.contains(a) & low.contains(b)
    out = F.when(any_of(low, INTENT_NEEDLES[0][1]), INTENT_NEEDLES[0][0])
    for name, needles in INTENT_NEEDLES[1:]:
        out = out.when(any_of(low, needles), name)
    return (
        out.when(both("support", "oppose") | low.startswith("support for ") | low.contains(" support for "), "support-oppose")
        .when(both("approve", "disapprove") | low.contains("approval"), "approval")
        .when(both("favorable", "unfavorable") | low.contains("favorability"), "favorability")
        .when(both("right direction", "wrong track"), "direction")
        .when(both("success", "failure"), "success-failure")
        .when(low.contains("which political party") & any_of(low, ("better plan", "policy or approach", "better job")), "party-advantage")
    )


def intent_of_label(text: Column) -> Column:
    return intent_of(search_text(text))
