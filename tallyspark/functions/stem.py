"""The published English (Porter 2) stemming algorithm, for distinct tokens only.

It is a small helper: jobs stem the distinct tokens of a table, or of what a worker reads, once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

#: Fixed words of the algorithm's description.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STOP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
V = "[aeiouy]"
SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    head = re.match("gener|commun|arsen", w)
    if head:
        r1 = head.end()
    else:
        m = REGION.search(w)
        r1 = m.end() if m else len(w)
    m = REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word[1:] if word.startswith("'") else word
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(V, w[:-2]):
        w = w[:-1]
    if w in STOP_AFTER_1A:
        return w
    # past forms and -ing
    if m := re.search("(?:eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(?:ingly|edly|ing|ed)$", w)) and re.search(V, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # suffixes to shorter ones
    for end, new in STEP_2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in STEP_3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(stem, na_action="ignore")


def stem_of(token: Column) -> Column:
    return F.pandas_udf(_stems, "string")(token)
