"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of variable order holds how often each byte followed each context of up to
`order` bytes. A text's code length under a language is exact: at each byte the longest context that the tree has
predicts it, with an escape (method C: as many escape counts as the context has different successors) to the next
shorter context for a byte not seen there, and 8 bits below order zero. The statistics are frozen; the language with
the shortest code wins, ties going to the first in sorted order.

The trees are counted in Spark on a bounded sample of rows with a language: at most `docs_per_language` texts for each
language, whatever their length, and at most `bytes_per_doc` bytes of each, taken in slices over the whole text; the
same ones in each run. Contexts of three and more bytes with a single observation are pruned. Every whole text is
scored, a very long one in blocks of `BLOCK` bytes that begin with the bytes before them as context.

The counts stay in a written table. The driver and the workers hold the tables of one group of languages at a time,
of at most `CELLS` numbers, whatever the number of languages; a single language has at most as many grams as its sample
has bytes. Few languages are one group and one pass without a shuffle. With more groups the rows are written once with
numbers, every group's tables score all of them, and each row's shortest code is an aggregate over the groups.

Defined results: `und` and score 0 for a null text, a text without a letter, and where nothing could be learned; null
ids and null languages are never learned from; repeated rows are scored each; columns named like an output column are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_sample, crc_mod, fresh_name, map_texts, materialize, slices

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes scored at once in a worker.
BLOCK = 1 << 20
#: Numbers, grams times languages, that the tables of a group of languages have at most, if it is more than one language.
CELLS = 1 << 25


def gram_codes(data: np.ndarray, length: int) -> np.ndarray:
    """For each byte the big-endian number of the `length` bytes that end there (shorter at the start)."""
    code = data.astype(np.uint64)
    out = code.copy()
    for k in range(1, length):
        out[k:] |= code[:-k] << np.uint64(8 * k)
    return out


class _Table:
    """Gram numbers of one length to row numbers, by open addressing; both filled and searched as whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.rows[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.rows[slot[put]] = keys[todo[put]], todo[put]
            left = np.ones(len(todo), dtype=bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row number of each code, -1 for those that are not there."""
        slot = self._slot(codes)
        rows = self.rows[slot].copy()
        wrong = np.flatnonzero((rows >= 0) & (self.keys[slot] != codes))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            rows[wrong] = self.rows[slot[wrong]]
            wrong = wrong[(rows[wrong] >= 0) & (self.keys[slot[wrong]] != codes[wrong])]
        return rows


class PpmModel:
    """Frozen trees of all languages: for every gram its cost in bits, and the cost of an escape from it as a context."""

    def __init__(self, counts: pd.DataFrame, languages: list[str], order: int) -> None:
        """counts: language, length (1 to order + 1), gram, n."""
        self.languages, self.order = languages, order
        width = len(languages)
        number = {x: i for i, x in enumerate(languages)}
        which = counts["language"].map(number).to_numpy(dtype=np.int64)
        length, gram, n = (counts[c].to_numpy() for c in ("length", "gram", "n"))
        gram = gram.astype(np.uint64)
        self.tables: list[_Table] = [_Table(np.zeros(1, dtype=np.uint64))]  # of length 0: the empty context
        self.cost: list[np.ndarray] = [np.full((1, width), 8.0)]  # below order zero: any of 256 bytes
        self.escape: list[np.ndarray] = []
        for m in range(1, order + 2):
            own = length == m
            keys = np.arange(256, dtype=np.uint64) if m == 1 else np.unique(gram[own])
            seen = np.zeros((len(keys), width))
            np.add.at(seen, (np.searchsorted(keys, gram[own]), which[own]), n[own])
            above = self.tables[m - 1].find(keys >> np.uint64(8)) if m > 1 else np.zeros(len(keys), dtype=np.int64)
            total, kinds = np.zeros((len(self.cost[m - 1]) if m > 1 else 1, width)), np.zeros((len(self.cost[m - 1]) if m > 1 else 1, width))
            np.add.at(total, above, seen)
            np.add.at(kinds, above, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
                here = np.log2((total + kinds)[above] / seen)
            shorter = self.cost[m - 1][self.tables[m - 1].find(keys & np.uint64((1 << 8 * (m - 1)) - 1))] if m > 1 else self.cost[0][np.zeros(len(keys), dtype=np.int64)]
            self.escape.append(escape)  # by context of length m - 1
            self.cost.append(np.where(seen > 0, here, escape[above] + shorter))
            self.tables.append(_Table(keys))
        self.cost = [x.astype(np.float32) for x in self.cost]
        self.escape = [x.astype(np.float32) for x in self.escape]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        place = np.arange(len(data)) - np.repeat(starts, sizes[full])
        out[full] = np.add.reduceat(self._by_byte(gram_codes(data, self.order + 1), place), starts, axis=0, dtype=np.float64)
        return out

    def _by_byte(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        costs = np.zeros((len(codes), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(codes))
        for m in range(self.order + 1, 0, -1):
            here = codes[todo] & np.uint64((1 << 8 * m) - 1)
            inside = place[todo] >= m - 1  # else the context would reach before the text
            rows = np.where(inside, self.tables[m].find(here), -1)
            found = rows >= 0
            costs[todo[found]] += self.cost[m][rows[found]]
            left = ~found
            if m > 1:
                above = self.tables[m - 1].find(here[left] >> np.uint64(8))
                known = (above >= 0) & inside[left]
                costs[todo[left][known]] += self.escape[m - 1][above[known]]
            todo = todo[left]
            if not len(todo):
                break
        return costs

    def long_bits(self, raw: bytes) -> np.ndarray:
        """Code length of one text under each language, block by block."""
        out = np.zeros(len(self.languages))
        for at in range(0, len(raw), BLOCK):
            before = min(at, self.order)
            data = np.frombuffer(raw, dtype=np.uint8, count=min(BLOCK, len(raw) - at) + before, offset=at - before)
            place = np.arange(len(data)) + (at - before)
            out += self._by_byte(gram_codes(data, self.order + 1)[before:], place[before:]).sum(0, dtype=np.float64)
        return out

    def shortest(self, texts: list[str | None]) -> tuple[list[str | None], list[float | None], list[float | None]]:
        """Language with the shortest code, its bits, and the sum of 2 ** -(bits more than these); None where no language can be told."""
        names, least, sums = [None] * len(texts), [None] * len(texts), [None] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        at = 0
        while at < len(todo):
            part, size = [], 0
            while at < len(todo) and (not part or size < BLOCK):
                raw = texts[todo[at]].encode()
                part.append((todo[at], raw))
                size += len(raw)
                at += 1
            bits = self.bits([raw for _, raw in part]) if len(part) > 1 else self.long_bits(part[0][1])[None]
            best = bits.argmin(1)
            total = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
            for (i, _), b, own, s in zip(part, best, bits.min(1), total):
                names[i], least[i], sums[i] = self.languages[b], float(own), float(s)
        return names, least, sums

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its share among 2 ** -bits of all languages."""
        names, _, sums = self.shortest(texts)
        return [n or UNKNOWN for n in names], [1 / s if s else 0.0 for s in sums]


def language_groups(sizes: list[tuple[str, int]], cells: int) -> list[list[str]]:
    """Languages (with their numbers of grams, in order) in groups of at most so many grams times languages each."""
    groups: list[list[str]] = []
    grams = 0
    for name, size in sizes:
        if groups and (grams + size) * (len(groups[-1]) + 1) <= cells:
            groups[-1].append(name)
            grams += size
        else:
            groups.append([name])
            grams = size
    return groups


class Trees(NamedTuple):
    """The trees of all languages: a written table of counts, and the groups whose tables are made of it one at a time."""

    counts: DataFrame
    groups: list[list[str]]
    order: int

    def model(self, group: list[str]) -> PpmModel:
        own = self.counts if len(self.groups) <= 1 else self.counts.where(F.col("language").isin(group))
        return PpmModel(own.toArrow().to_pandas(), group, self.order)


def drawn(raw: bytes, most: int, parts: int = 8) -> list[bytes]:
    """The text, or slices of it from its begin to its end that have `most` bytes together."""
    if len(raw) <= most:
        return [raw]
    size = most // parts
    return [raw[at : at + size] for at in np.linspace(0, len(raw) - size, parts).astype(int).tolist()]


def gram_counts(df: DataFrame, order: int, text_col: str, lang_col: str, bytes_per_doc: int = 8192) -> DataFrame:
    """language, length, gram and n over the texts of df, summed in each batch before the shuffle."""

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1), 256):
                part = batch.slice(at, n)
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).extend(drawn(text.encode(), bytes_per_doc))
                for lang, texts in by_lang.items():
                    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                    sizes = np.array([len(t) for t in texts])
                    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    codes = gram_codes(data, order + 1)
                    for m in range(1, order + 2):
                        grams, n = np.unique(codes[place >= m - 1] & np.uint64((1 << 8 * m) - 1), return_counts=True)
                        k = len(grams)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(np.full(k, m, dtype=np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["language", "length", "gram", "n"])

    parts = df.select(F.col(lang_col).alias("language"), F.col(text_col).alias("text")).mapInArrow(run, "language string, length int, gram long, n long")
    return parts.groupBy("language", "length", "gram").agg(F.sum("n").alias("n"))


def learn_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = 4, docs_per_language: int = 400, bytes_per_doc: int = 8192, cells: int | None = None) -> Trees:
    """Count the trees on the bounded sample; df holds the rows that may be learned from."""
    usable = df.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0) & F.col(text_col).rlike(r"\p{L}"))
    sample = bounded_sample(usable, id_col, docs_per_language, seed=10, within=lang_col)
    counts = gram_counts(sample, order, text_col, lang_col, bytes_per_doc).where("length <= 2 or n >= 2").sortWithinPartitions("language")
    written = materialize(counts, "language-grams")
    sizes = [(r["language"], r["count"]) for r in written.groupBy("language").count().collect()]  # one row a language
    return Trees(written, language_groups(sorted(sizes), cells or CELLS), order)


def identify_language(df: DataFrame, trees: Trees, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its score to every row."""
    spark = df.sparkSession
    if len(trees.groups) <= 1:
        shared = spark.sparkContext.broadcast(trees.model(trees.groups[0] if trees.groups else []))

        def make():
            return lambda texts: list(shared.value.predict(texts))

        return map_texts(df, text_col, [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())], make)
    row, codes, best = fresh_name(df, "_row"), fresh_name(df, "_codes"), fresh_name(df, "_best")
    kept = [c for c in df.columns if c not in (lang_out, score_out) or c == text_col]
    rows = materialize(df.select(*kept, F.monotonically_increasing_id().alias(row)), "language-rows")
    texts = rows.select(row, F.col(text_col).alias("text"))
    parts = [materialize(_shortest_codes(texts, row, trees.model(group)), "language-codes") for group in trees.groups]
    # a text has one code a group at most
    code = F.struct(F.col("bits"), F.col("name"), F.col("total"))
    every = reduce(DataFrame.unionAll, parts).groupBy(row).agg(F.collect_list(code).alias(codes)).withColumn(best, F.array_min(codes))
    total = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c["total"] * F.pow(F.lit(2.0), -F.least(c["bits"] - F.col(best)["bits"], F.lit(1000.0))))
    told = every.select(row, F.col(best)["name"].alias(lang_out), (1 / total).alias(score_out))
    out = rows.select(row, *[c for c in kept if c not in (lang_out, score_out)]).join(told, row, "left").drop(row)
    return out.withColumns({lang_out: F.coalesce(lang_out, F.lit(UNKNOWN)), score_out: F.coalesce(score_out, F.lit(0.0))})


def _shortest_codes(texts: DataFrame, row: str, model: PpmModel) -> DataFrame:
    """Number of each text that has a letter, and the shortest of its codes under the model's languages."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("name", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("total", T.DoubleType())]

    def make():
        return lambda part: list(shared.value.shortest(part))

    return map_texts(texts, "text", fields, make).drop("text").where("name is not null")


def predict_held_out(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, and predict all: id, held_out, lang_pred, score."""
    marked = df.select(id_col, text_col, lang_col, (crc_mod(id_col) == 0).alias("held_out"))
    trees = learn_languages(marked.where("not held_out"), text_col, lang_col, id_col)
    return identify_language(marked.select(id_col, "held_out", text_col), trees, text_col).drop(text_col)
