"""Quality rules: rule statistics of every text, and an isolation forest over them.

The statistics are counted in one pass over the whole texts. A forest of random splits is grown for each group of
statistics (`GROUPS`) on a bounded sample of the rows that pass the base rules; a document that few splits isolate (a
short mean path) is anomalous. One forest over all of them would hide what is odd in one group behind the usual spread
of the others. The thresholds on the anomalies are calibrated on all labelled rows, one group after the other on the
rows that those before it keep: of the thresholds that leave the rejected part of the rows labelled good at most
`max_false_reject` in all, the one with the largest share of bad rows rejected less that of good ones.

Words are runs of anything but space and U+0009 to U+000D. Defined results: a null or empty text has no words and
fails the base rules; without labels of both kinds the forest rejects nothing; repeated rows are judged each; columns
of the input that are named like a statistic are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import PIECE, bounded_sample, hashed_words, map_texts, materialize

#: Characters that count as symbols; fixed by the rule.
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counts that only the forest uses.
EXTRA = ("n_lines", "n_distinct_words", "n_upper", "n_lower", "n_marks", "n_digits")


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts BASE and EXTRA of one text."""
    if not text:
        return (0,) * (len(BASE) + len(EXTRA))
    if len(text) > PIECE:
        return long_statistics(text)
    raw = text.encode()
    words = raw.split()  # of bytes: splits at exactly the six ASCII spaces
    n = len(words)
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    spaces = int(by_byte[9:14].sum() + by_byte[32])
    symbols = int(sum(by_byte[ord(c)] for c in SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(seen := set(windows)) < len(windows):
            repeated = _covered(windows, seen)
    return (
        n, len(text) - spaces, symbols, dup_lines, repeated,
        len(lines), len(set(words)), int(by_byte[65:91].sum()), int(by_byte[97:123].sum()), int(by_byte[33:48].sum() + by_byte[58:65].sum()), int(by_byte[48:58].sum()),
    )


def long_statistics(text: str) -> tuple[int, ...]:
    """The same counts of a very long text; its words are told by 64-bit hashes, which take 8 bytes each."""
    raw = text.encode()
    by_byte = np.zeros(256, dtype=np.int64)
    for at in range(0, len(raw), PIECE):
        by_byte += np.bincount(np.frombuffer(raw, dtype=np.uint8, count=min(PIECE, len(raw) - at), offset=at), minlength=256)
    spaces, symbols = int(by_byte[9:14].sum() + by_byte[32]), int(sum(by_byte[ord(c)] for c in SYMBOLS))
    n_lines, seen, at = 0, set(), 0
    while at <= len(raw):
        end = raw.find(b"\n", at)
        line = raw[at : end if end >= 0 else len(raw)]
        if line.strip():
            n_lines += 1
            seen.add(line)
        at = (end if end >= 0 else len(raw)) + 1
    words, _ = hashed_words(pa.array([text]), lower=False)
    n = len(words)
    window = np.zeros(max(n - 2, 0), dtype=np.uint64)
    for k in range(3 if n > 2 else 0):
        window = (window ^ (window >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : n - 2 + k]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marked = np.zeros(n, dtype=bool)
    for k in range(3 if n > 2 else 0):
        marked[k : k + len(twice)] |= twice
    return (
        n, len(text) - spaces, symbols, n_lines - len(seen), int(marked.sum()),
        n_lines, len(np.unique(words)), int(by_byte[65:91].sum()), int(by_byte[97:123].sum()), int(by_byte[33:48].sum() + by_byte[58:65].sum()), int(by_byte[48:58].sum()),
    )


def _covered(windows: list[tuple], seen: set) -> int:
    """Words that lie in a window which occurs twice or more."""
    number = dict(zip(seen, range(len(seen))))
    at = np.array([number[w] for w in windows])
    twice = np.bincount(at)[at] >= 2
    marked = np.zeros(len(at) + 2, dtype=bool)
    for k in range(3):
        marked[k : k + len(at)] |= twice
    return int(marked.sum())


def rule_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts BASE and EXTRA (long) of a text column."""

    def make():
        def run(texts: list) -> list[list]:
            return [list(x) for x in zip(*map(statistics, texts))] or [[] for _ in (*BASE, *EXTRA)]

        return run

    return map_texts(df, text_col, [T.StructField(n, T.LongType()) for n in (*BASE, *EXTRA)], make)


def features(p: pd.DataFrame) -> np.ndarray:
    """Ratios of the counts, so that a long clean text looks like a short clean one."""
    words, chars = np.maximum(p["n_words"], 1), np.maximum(p["word_chars"], 1)
    letters = np.maximum(p["n_upper"] + p["n_lower"], 1)
    return np.column_stack([
        np.log(chars / words), np.sqrt(p["n_symbols"] / chars), p["n_dup_lines"] / np.maximum(p["n_lines"], 1), np.sqrt(p["n_repeat_words"] / words),
        np.sqrt(p["n_upper"] / letters), np.sqrt(p["n_marks"] / chars), np.sqrt(p["n_digits"] / chars), np.minimum(1, p["n_distinct_words"] / np.maximum(words**0.85, 1)),
    ]).astype(np.float64)


#: Columns of `features` that a forest takes together.
GROUPS = {"symbols": (1,), "marks": (5, 6), "repetition": (2, 3, 7), "form": (0, 4)}


class IsolationForest:
    """Random splits stored as arrays; a row's path length is that to its leaf plus the mean for the leaf's size."""

    def __init__(self, x: np.ndarray, trees: int = 128, rows: int = 256, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.depth = max(1, math.ceil(math.log2(max(self.rows, 2))))
        self.trees = [self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees)] if len(x) else []

    @staticmethod
    def mean_path(n: float) -> float:
        return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Complete binary tree: feature (-1: leaf), split value, path length where a row ends."""
        size = 2 ** (self.depth + 1)
        feature, split, length = np.full(size, -1), np.zeros(size), np.zeros(size)
        todo = [(1, x, 0)]
        while todo:
            k, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(high > low)
            if depth == self.depth or len(part) <= 1 or not len(wide):
                length[k] = depth + self.mean_path(len(part))
                continue
            feature[k] = f = rng.choice(wide)
            split[k] = s = rng.uniform(low[f], high[f])
            left = part[:, f] < s
            if not left.any() or left.all():  # the split fell on an edge
                feature[k], length[k] = -1, depth + self.mean_path(len(part))
                continue
            todo += [(2 * k, part[left], depth + 1), (2 * k + 1, part[~left], depth + 1)]
        return feature, split, length

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 is anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, length in self.trees:
            k = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[k]
                inner = f >= 0
                k = np.where(inner, 2 * k + (x[rows, f] >= split[k]), k)
            total += length[k]
        return 2.0 ** (-total / (max(len(self.trees), 1) * max(self.mean_path(self.rows), 1e-9)))


def base_rule(min_words: int, max_repeat_percent: int) -> Column:
    """Whether the base rules reject a row."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def quality_rules(
    df: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    sample_rows: int = 20_000,
    max_false_reject: float = 0.01,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """id, statistics, anomalies (one a group), anomaly (the largest), base_failed and kept of every row.

    labels: id and quality (1 good, 0 bad). sample_rows bounds the rows on which the forests are grown; the thresholds
    are taken over all labelled rows, by counts of their anomaly in steps of 1/2000.
    """
    counted = materialize(rule_statistics(df.select(id_col, text_col), text_col).drop(text_col), "rule-statistics")
    usual = counted.where(~base_rule(min_words, max_repeat_percent))
    sample = features(bounded_sample(usual, id_col, sample_rows).select(id_col, *BASE, *EXTRA).orderBy(id_col).toPandas())
    forests = df.sparkSession.sparkContext.broadcast([(list(columns), IsolationForest(sample[:, list(columns)])) for columns in GROUPS.values()])

    @F.pandas_udf("array<double>")
    def anomalies(p: pd.DataFrame) -> pd.Series:
        x = features(p)
        return pd.Series(list(np.column_stack([forest.anomaly(x[:, columns]) for columns, forest in forests.value])))

    scored = counted.withColumn("anomalies", anomalies(F.struct(*BASE, *EXTRA))).withColumn("base_failed", base_rule(min_words, max_repeat_percent))
    scored = materialize(scored, "rule-anomalies")
    marked = labels.groupBy(F.col(id_col)).agg(F.min("quality").alias("quality")).where("quality is not null")
    known = materialize(scored.where("not base_failed").join(marked, id_col).select("quality", "anomalies"), "rule-labelled")
    total = known.where("quality = 1").count()
    steps, left, kept, lost = 2000, known, F.lit(True), 0
    for k in range(len(GROUPS)):
        hist = left.groupBy("quality", F.floor(F.col("anomalies")[k] * steps).alias("step")).count().collect()
        threshold, more = calibrate([(r["quality"], r["step"], r["count"]) for r in hist], steps, int(max_false_reject * total) - lost)
        left, kept, lost = left.where(F.col("anomalies")[k] < threshold), kept & (F.col("anomalies")[k] < threshold), lost + more
    return scored.withColumns({"anomaly": F.array_max("anomalies"), "kept": ~F.col("base_failed") & kept})


def calibrate(counts: list[tuple[int, int, int]], steps: int, may_lose: int) -> tuple[float, int]:
    """The threshold that sets bad rows best apart from good ones, and how many good rows it rejects: `may_lose` at most.

    Infinity without labels of both kinds, and where no threshold rejects a larger share of the bad rows.
    """
    good, bad = np.zeros(steps + 2), np.zeros(steps + 2)
    for quality, step, n in counts:
        (good if quality == 1 else bad)[min(max(step, 0), steps + 1)] += n
    if not good.sum() or not bad.sum():
        return math.inf, 0
    lost, caught = (np.cumsum(x[::-1])[::-1] for x in (good, bad))  # if the threshold is this step's lower edge
    gain = np.where(lost <= may_lose, caught / bad.sum() - lost / good.sum(), 0.0)
    best = int(np.argmax(gain))
    return (best / steps, int(lost[best])) if gain[best] > 0 else (math.inf, 0)
