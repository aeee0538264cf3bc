"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule fits.

Everything is a DataFrame expression or a model of pyspark.ml, which runs in the JVM. The trees learn from labelled
URLs: length, depth, digit ratio, character entropy, number of parameters and the like, and for the last one, two and
three labels of the host how often URLs with them are blocked; so for the first part of the path, by its hash in `LEADS`
buckets, which bounds the table whatever the paths are. These rates are counted over all labelled URLs. For the
rows that the trees learn from they come from the other hosts only (`FOLDS` folds of hosts), as a rate that a row is
part of tells its label; and in one fold they count as unseen, so that the trees also learn to judge URLs of unknown
suffixes. The labelled URLs of the query are those that a rule decides. The trees are grown on a bounded sample of
distinct URLs; the verdict is given to every row. Rates are broadcast up to `SENT` suffixes, beyond that shuffled.

Defined results: a null URL or one without `://` has empty host and path, fits no rule and is judged by its features;
with labels of one kind that verdict is given, without any `allow`; repeated rows are judged each; ties between rules
go to the one listed first; columns named like an output column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host/path) rules of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "escapes", "longest_part", "has_fragment", "has_scheme_s")
#: Levels of suffixes, by number of labels.
SUFFIXES = {"suffix": 1, "domain": 2, "site": 3}
#: Columns that have rates, and buckets of first parts of paths.
LEVELS, LEADS = (*SUFFIXES, "lead"), 1 << 16
RATES = tuple(f"{level}_{what}" for level in LEVELS for what in ("rate", "seen"))
FOLDS, SENT = 5, 200_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does; a rule fits its host and all below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def count_of(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def level_of(level: str) -> Column:
    """A suffix of the host, or the bucket of the path's first part."""
    if level in SUFFIXES:
        return F.substring_index("host", ".", -SUFFIXES[level])
    return F.pmod(F.xxhash64(F.lit(43), F.regexp_extract("path", "^/([^/]*)", 1)), F.lit(LEADS))


def with_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the LEXICAL columns and those of LEVELS; df has host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0))
    many = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double")
    spread = F.log2(size) - F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total + many(c) * F.log2(many(c))) / size
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    values = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": count_of(F.col("path"), "/"),
        "labels": count_of(F.col("host"), "."),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
        "entropy": spread,
        "parameters": F.when(query == "", 0).otherwise(count_of(query, "&") + 1),
        "hyphens": count_of(url, "-"),
        "escapes": count_of(url, "%"),
        "longest_part": F.array_max(F.transform(F.split("path", "/"), F.length)),
        "has_fragment": url.contains("#").cast("int"),
        "has_scheme_s": url.startswith("https:").cast("int"),
    }
    return df.withColumns({k: v.cast("double") for k, v in values.items()}).withColumns({level: level_of(level) for level in LEVELS})


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(41)), F.lit(FOLDS))


def level_counts(known: DataFrame, level: str) -> DataFrame:
    """URLs and blocked URLs of each fold, by level; known: host, path and label. Summed up before the shuffle."""
    own = known.select(level_of(level).alias(level), fold_of(F.col("host")).alias("fold"), "label")
    of_fold = lambda k, what: F.sum(F.when(F.col("fold") == k, what).otherwise(0.0))
    counted = own.groupBy(level).agg(F.array(*[of_fold(k, F.lit(1.0)) for k in range(FOLDS)]).alias(f"{level}_n"), F.array(*[of_fold(k, F.col("label")) for k in range(FOLDS)]).alias(f"{level}_blocked"))
    return materialize(counted, f"rates-{level}")


def with_rates(df: DataFrame, tables: list[DataFrame], learning: bool) -> DataFrame:
    """Add the RATES columns: smoothed share of blocked URLs and log number of URLs; df has host and the columns of LEVELS.

    learning: without the row's own fold, and for hosts of fold 0 as if all levels were unseen.
    """
    fold = fold_of(F.col("host"))
    for level, counts in zip(LEVELS, tables):
        df = df.join(F.broadcast(counts) if counts.count() <= SENT else counts, level, "left")

        def total(name: str, level: str = level) -> Column:
            all_of = F.coalesce(F.aggregate(f"{level}_{name}", F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
            if not learning:
                return all_of
            return F.when(fold == 0, 0.0).otherwise(all_of - F.coalesce(F.get(f"{level}_{name}", fold.cast("int")), F.lit(0.0)))

        n, blocked = total("n"), total("blocked")
        df = df.withColumns({f"{level}_rate": (blocked + 1) / (n + 2), f"{level}_seen": F.log1p(n)}).drop(f"{level}_n", f"{level}_blocked")
    return df


class UrlModel:
    """Boosted trees over lexical features and rates of suffixes and first parts of paths, or the only kind of label there is."""

    def __init__(self, known: DataFrame, url_col: str, sample_rows: int, trees: int, depth: int) -> None:
        """known: url, host, path and label (1: block)."""
        kinds = [r["label"] for r in known.select("label").distinct().collect()]
        self.only = None if len(kinds) > 1 else kinds[0] if kinds else 0.0
        self.url_col = url_col
        if self.only is None:
            self.tables = [level_counts(known, level) for level in LEVELS]
            sample = materialize(bounded_sample(known.select(url_col, "host", "path", "label"), url_col, sample_rows, seed=30), "url-sample")
            self.vector = VectorAssembler(inputCols=[*LEXICAL, *RATES], outputCol="_vector")
            learned = self.vector.transform(with_rates(with_features(sample, url_col), self.tables, learning=True)).select("_vector", "label")
            learned = materialize(learned, "url-features").coalesce(4).cache()
            self.trees = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5).fit(learned)
            learned.unpersist()

    def score(self, df: DataFrame) -> DataFrame:
        """Add block_score to rows with url, host and path."""
        if self.only is not None:
            return df.withColumn("block_score", F.lit(float(self.only)))
        judged = self.trees.transform(self.vector.transform(with_rates(with_features(df, self.url_col), self.tables, learning=False)))
        return judged.withColumn("block_score", vector_to_array("probability")[1])


def labelled_urls(df: DataFrame, url_col: str) -> DataFrame:
    """url, host, path and label of rows with url and verdict."""
    host, path = url_parts(F.col(url_col))
    known = df.where(F.col(url_col).isNotNull() & F.col("verdict").isin("allow", "block"))
    return known.select(url_col, host.alias("host"), path.alias("path"), (F.col("verdict") == "block").cast("double").alias("label"))


def filter_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    sample_rows: int = 10_000,
    trees: int = 12,
    depth: int = 4,
) -> DataFrame:
    """id, host, path, rule, verdict and the trees' score (how likely block is) of every row.

    labelled: url and verdict; without it the URLs that a rule decides are the labelled ones. sample_rows bounds the
    distinct URLs on which the trees are grown.
    """
    host, path = url_parts(F.col(url_col))
    ruled = df.select(id_col, url_col, host.alias("host"), path.alias("path"))
    rule, say = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumns({"rule": rule, "said": say})
    known = ruled.withColumn("verdict", F.col("said")) if labelled is None else labelled.select(F.col("url").alias(url_col), "verdict")
    model = UrlModel(labelled_urls(known, url_col), url_col, sample_rows, trees, depth)
    verdict = F.coalesce("said", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return model.score(ruled).select(id_col, "host", "path", "rule", verdict.alias("verdict"), "block_score")
