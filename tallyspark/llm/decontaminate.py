"""Benchmark decontamination by template windows.

Words become template tokens: numbers, names, units and quantities turn into typed placeholders, other words into their
lower-case spelling without outer marks. Windows of `WINDOW` tokens of the texts are hash-joined with those of the
benchmark items. Matches of a text with an item on one diagonal (the same shift between both) form an alignment. In it
each value of the item belongs to the value of the text that it stands against in most windows (equally many: itself,
or none), and two names may not belong to one, though two numbers may; windows with another pair are dropped, but those
whose slots are all equal always count. So a passage is found as it is and with other numbers, names or units.

What is a name depends on capitals and on the text in front, so windows have a second key: the same tokens in lower
case without placeholders. Windows that are equal by this plain key always count; so a verbatim passage is found in any
case and behind any text. A text is contaminated by an item if alignments cover half of the item's windows (all of
them, or those by templates alone), or one of them `RUN_WINDOWS` windows.

A window that k different items hold is no sign of one of them and weighs 1/k in these sums, so that an instruction in
front of many items contaminates nothing by itself. Items of equal words are one item here, and for a window by templates
those of one template are, unless they hold its words as well; all of them are reported. An item's least common windows
weigh 1, and its others as much less as more items hold them, as there may be none of its own.

So that no text meets all items of a benchmark by a window of more than `COMMON` items, the most common windows of an
item are compared only where the text and the item share another one, as long as they can't weigh enough together for
any of these limits. So no pair is left out, and no result depends on `COMMON`.

The hashes of the benchmark's windows are sent to all tasks if there are at most `MAX_SENT` of them; then only windows
that occur there leave a task. Beyond that all windows are joined by a shuffle. Both give the same rows. Windows with
their items are sent as well if there are at most `MAX_JOINED`, so that a frequent window is not one task.

In scripts without spaces each character is a token.

Defined results: null and empty texts and items match nothing; items with fewer than `WINDOW` tokens are one shorter
window, by the plain key alone below `LEAST` tokens; items of fewer than `least` words (a parameter; by default one or
two words are no passage) are not searched for, and `short_items` lists them; template
windows with fewer than half literal tokens are not used;
repeated rows and rows with null ids are judged by their texts; tied items are all reported; an empty table or
benchmark gives no match; columns of the input other than id and text are ignored. A very long text is tokenised in
pieces and its windows are hashed in blocks, so that it takes some 25 bytes of memory a word beside the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import bind
from .common import fresh_name, materialize, numbered_words, piece_blocks, slices, spelling_hashes

WINDOW, LEAST, LEAST_PLAIN, RUN_WINDOWS, MAX_SENT, MAX_JOINED = 8, 5, 3, 6, 2_000_000, 100_000
#: Items that hold a window, up to which it brings texts and items together by itself.
COMMON = 32
#: Tokens whose windows are hashed at once.
BLOCK = 1 << 18
#: ASCII marks that are dropped around a word; "$" and "%" stay.
ASCII_MARKS = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~"
OUTER = regex.compile(r"^[^\p{L}\p{N}$€£%]+|[^\p{L}\p{N}$€£%]+$")
#: Characters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana and Han.
SPACELESS = "([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])"
NUMBER = regex.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
QUANTITY = regex.compile(r"\d[\d.,]*([\p{L}°/²³]+)")
#: Fixed words: units, and spelled numbers.
UNITS = "mg g kg t lb lbs oz mm cm m km mile miles yard yards foot feet inch inches ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh km/h m/s % percent degree degrees dollar dollars euro euros pound pounds cent cents usd eur watt watts volt volts joule joules kwh".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
#: Marks the hashes of plain windows.
PLAIN = 1 << 20
LITERAL, NAME, NUM, UNIT, QUANT, NOTHING = range(6)
PLACEHOLDER = np.concatenate([[np.uint64(0)], spelling_hashes(pa.array(["<name>", "<num>", "<unit>", "<quantity>"]))])


def flags(mask: pa.Array) -> np.ndarray:
    return mask.to_numpy(zero_copy_only=False).astype(bool)


def changed(words: pa.Array, where: np.ndarray, how) -> pa.Array:
    """The words, those at `where` changed one by one."""
    if not where.any():
        return words
    return pc.replace_with_mask(words, pa.array(where), pa.array([how(w) for w in words.filter(pa.array(where)).to_pylist()], type=words.type))


def token_kind(word: str) -> int:
    """Kind of a lower-case word that is not of letters alone."""
    if NUMBER.fullmatch(word):
        return NUM
    m = QUANTITY.fullmatch(word)
    return QUANT if m and m[1] in UNITS else LITERAL


class Tokens:
    """The tokens of some texts, in arrays: literal or placeholder code, plain code, kind, number of the text."""

    def __init__(self, texts: pa.Array) -> None:
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("owner", "value", "code", "plain", "kind", "ends", "capital", "unit")}
        self._spellings: list[pa.Array] = []
        self._first: list[int] = []
        known = 0
        for number, part in piece_blocks(texts):
            if not flags(pc.string_is_ascii(part)).all():
                part = pc.replace_substring_regex(part, SPACELESS, " \\1 ")
            of, owner, words = numbered_words(part)
            for k, v in self._of_words(words).items():
                parts[k].append(v[of])
            parts["value"].append(of + known)
            parts["owner"].append(number[owner])
            self._first.append(known)
            known += len(words)
        a = {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in parts.items()}
        start = np.ones(len(a["owner"]), dtype=bool)  # of a sentence
        start[1:] = a["ends"][:-1].astype(bool) | (a["owner"][1:] != a["owner"][:-1])
        real = a["kind"] != NOTHING
        a, start = {k: v[real] for k, v in a.items()}, start[real]
        kind = np.where((a["kind"] == LITERAL) & a["capital"].astype(bool) & ~start, NAME, a["kind"])
        after_number = np.zeros(len(kind), dtype=bool)
        after_number[1:] = kind[:-1] == NUM
        self.kind = np.where(a["unit"].astype(bool) & after_number, UNIT, kind).astype(np.int8)
        self.literal = self.kind == LITERAL
        self.code = np.where(self.literal, a["code"], PLACEHOLDER[np.minimum(self.kind, QUANT)]).astype(np.uint64)
        self.plain, self.value, self.owner = a["plain"].astype(np.uint64), a["value"], a["owner"]
        self.begin = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def _of_words(self, words: pa.Array) -> dict[str, np.ndarray]:
        """What each distinct word is by itself."""
        bare = pc.utf8_trim(words, characters=ASCII_MARKS)
        bare = changed(bare, ~flags(pc.utf8_is_alnum(bare)), lambda w: OUTER.sub("", w))
        low = pc.utf8_lower(bare)
        self._spellings.append(low)
        code = spelling_hashes(low)
        foreign = ~flags(pc.string_is_ascii(low))
        folded = changed(bare, foreign, str.casefold).filter(pa.array(foreign))
        plain = code.copy()
        plain[foreign] = spelling_hashes(folded)
        empty = flags(pc.equal(low, ""))
        kind = np.where(empty, NOTHING, np.where(flags(pc.is_in(low, value_set=pa.array(NUMBER_WORDS))), NUM, LITERAL))
        other = ~empty & (kind == LITERAL) & ~flags(pc.utf8_is_alpha(low))
        kind[other] = [token_kind(w) for w in low.filter(pa.array(other)).to_pylist()]
        last = pc.utf8_rtrim(words, characters="\"')]*#&$%|")
        size = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
        capital = flags(pc.utf8_is_upper(pc.utf8_slice_codeunits(bare, 0, 1))) & ((size == 1) | flags(pc.utf8_is_lower(pc.utf8_slice_codeunits(bare, 1))))
        return {"code": code, "plain": plain, "kind": kind.astype(np.int8), "ends": flags(pc.match_substring_regex(last, "[.!?:;]$")), "capital": capital, "unit": flags(pc.is_in(low, value_set=pa.array(UNITS)))}

    def spelled(self, token: int) -> str:
        """The token's value in its slot: the word in lower case, a name with a mark."""
        block = int(np.searchsorted(self._first, self.value[token], side="right")) - 1
        word = self._spellings[block][int(self.value[token]) - self._first[block]].as_py()
        return f"@{word}" if self.kind[token] == NAME else word


class Windows:
    """Windows of texts by templates and by plain words.

    lengths: of the windows; wanted: sorted hashes of those to keep (None: all); sized: only windows of full length, or
    the whole text where it is shorter.
    """

    def __init__(self, lengths: tuple[int, ...] = (WINDOW,), wanted: np.ndarray | None = None, sized: bool = False) -> None:
        self.lengths, self.wanted, self.sized = lengths, wanted, sized
        if wanted is not None:
            self.quick = np.zeros(1 << 20, dtype=bool)
            self.quick[(wanted >> np.uint64(44)).astype(np.int64)] = True

    def of(self, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """text (its number), position, window (hash), slots, tokens (of the text) and plain of each window."""
        t = Tokens(texts)
        for at in range(0, len(t.code), BLOCK):
            for k in self.lengths:
                for is_plain in (False, True) if k >= LEAST else (True,):
                    first, hashes = self._hashed(t, at, min(at + BLOCK, len(t.code) - k + 1), k, is_plain)
                    if len(first):
                        owner = t.owner[first]
                        slots = [[] if is_plain else [t.spelled(q) for q in range(i, i + k) if not t.literal[q]] for i in first.tolist()]
                        columns = [pa.array(owner), pa.array((first - t.begin[owner]).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(slots, pa.list_(pa.string())), pa.array((t.begin[owner + 1] - t.begin[owner]).astype(np.int32)), pa.array(np.full(len(first), is_plain))]
                        yield pa.RecordBatch.from_arrays(columns, names=["text", "position", "window", "slots", "tokens", "plain"])

    def _hashed(self, t: Tokens, low: int, high: int, k: int, is_plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows of k tokens that begin in low:high and are to be kept."""
        n = high - low
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        tokens, owner = (t.plain if is_plain else t.code)[low : high + k - 1], t.owner[low : high + k - 1]
        h = np.full(n, np.uint64(k + is_plain * PLAIN), dtype=np.uint64)
        for j in range(k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += tokens[j : j + n]
        h ^= h >> np.uint64(31)
        usable = owner[:n] == owner[k - 1 :]
        if not is_plain:
            known = np.concatenate([[0], np.cumsum(t.literal[low : high + k - 1])])
            usable &= 2 * (known[k:] - known[:n]) >= k
        if self.sized:
            usable &= np.minimum(t.begin[owner[:n] + 1] - t.begin[owner[:n]], WINDOW) == k
        if self.wanted is None:
            at = np.flatnonzero(usable)
        elif len(self.wanted):
            at = np.flatnonzero(usable & self.quick[(h >> np.uint64(44)).astype(np.int64)])
            at = at[self.wanted[np.minimum(np.searchsorted(self.wanted, h[at]), len(self.wanted) - 1)] == h[at]]
        else:
            at = np.zeros(0, dtype=np.int64)
        return at + low, h[at]


def window_table(df: DataFrame, id_cols: list[str], text_col: str, make, rows_at_once: int = 512) -> DataFrame:
    """id columns, position, window (hash), slots, tokens (of the whole text) and plain of each window."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*id_cols).schema.fields]
    schema = ", ".join([*fields, "position int, window long, slots array<string>, tokens int, plain boolean"])

    def run(batches):
        windows = make()
        for batch in batches:
            for at, n in slices(batch.column(len(id_cols)), rows_at_once):
                part = batch.slice(at, n)
                for found in windows.of(part.column(len(id_cols))):
                    ids = [part.column(i).take(found.column(0)) for i in range(len(id_cols))]
                    yield pa.RecordBatch.from_arrays([*ids, *found.columns[1:]], names=[*id_cols, *found.schema.names[1:]])

    return df.select(*id_cols, text_col).mapInArrow(run, schema)


def keyed_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item id, item_key (hash of the text) and text of the items that have a text."""
    return benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col), F.xxhash64(text_col).alias("item_key"), F.col(text_col).alias("text"))


def short_items(benchmark: DataFrame, least: int = LEAST_PLAIN, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item id and tokens of the items with fewer than `least` tokens (and at least one), which are not searched for."""
    schema = f"`{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, tokens int"

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1), 512):
                part = batch.slice(at, n)
                tokens = pa.array(np.diff(Tokens(part.column(1)).begin).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), tokens], names=[item_col, "tokens"])

    return benchmark.select(item_col, text_col).mapInArrow(run, schema).where(F.col("tokens").between(1, least - 1))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", least: int = LEAST_PLAIN, common: int = COMMON) -> DataFrame:
    """Windows of the different item texts with their weights, and the weight of all of each kind that an item has.

    Items shorter than a window are one window. Of the windows that more than `common` items hold, an item's most common
    ones are marked (`aside`) as long as all of them together can't decide about it; no weight depends on that.
    """
    texts = keyed_items(benchmark, item_col, text_col).select("item_key", "text").dropDuplicates(["item_key"])
    every = materialize(window_table(texts, ["item_key"], "text", lambda: Windows(tuple(range(least, WINDOW + 1)), sized=True)), "item-windows")
    windows_of = lambda kind: F.xxhash64(F.sort_array(F.collect_list(F.when(F.col("plain") == kind, F.struct("position", "window")))))
    alike = every.groupBy("item_key").agg(windows_of(True).alias("words"), windows_of(False).alias("template"))
    held = every.join(alike, "item_key").groupBy("window").agg(F.count_distinct(F.when(F.col("plain"), F.col("words")).otherwise(F.col("template"))).alias("held"))
    place, item = Window.partitionBy("item_key", "position"), Window.partitionBy("item_key")
    weighed = every.join(held, "window").withColumn("held", F.when(F.col("plain"), F.col("held")).otherwise(F.max("held").over(place)))
    weighed = weighed.withColumn("weight", F.min("held").over(item) / F.col("held"))
    of_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("plain") == kind, F.col("weight"))), F.lit(0.0))
    sizes = weighed.groupBy("item_key").agg(of_kind(True).alias("of_item"), of_kind(False).alias("of_template"), F.max("tokens").alias("item_tokens"))
    kept = materialize(weighed.withColumnsRenamed({"position": "item_position", "slots": "item_slots"}).drop("tokens").join(sizes, "item_key"), "weighed-windows")
    least_common_last = item.orderBy(F.col("held").desc(), "item_position", "plain").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    together = F.sum("weight").over(least_common_last) + 1e-6
    little = lambda c: (F.col(c) == 0) | (2 * together < F.col(c))
    undecided = little("of_item") & little("of_template") & (together < RUN_WINDOWS)
    return kept.withColumn("aside", undecided & (F.col("held") > common)).drop("held")


def contaminated_pairs(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_sent: int = MAX_SENT, least: int = LEAST_PLAIN, common: int = COMMON) -> DataFrame:
    """id, text_key, item id, matched windows, coverage, longest alignment and whether the match is exact, of each contaminated pair.

    least: tokens of the shortest items that are searched for; common: items up to which a window of theirs makes pairs by itself.
    """
    items = materialize(benchmark_windows(benchmark, item_col, least=least, common=common), "benchmark-windows")
    lengths = tuple(sorted({min(WINDOW, r["item_tokens"]) for r in items.select("item_tokens").distinct().collect()}))
    docs = df.select(F.col(id_col), F.xxhash64(text_col).alias("text_key"), F.col(text_col)).where(F.col(text_col).isNotNull())
    hashes = materialize(items.select("window").distinct(), "window-hashes")
    n_hashes = hashes.count()
    if n_hashes <= max_sent:
        sent = df.sparkSession.sparkContext.broadcast(np.sort(hashes.toArrow().column(0).to_numpy().view(np.uint64)))
        hits = window_table(docs, [id_col, "text_key"], text_col, lambda: Windows(lengths, sent.value))
    else:
        hits = window_table(docs, [id_col, "text_key"], text_col, lambda: Windows(lengths)).join(hashes, "window", "left_semi")
    few = items.count() <= min(max_sent, MAX_JOINED)
    sized = lambda df: F.broadcast(df) if few else df
    aside = items.where("aside").drop("aside")
    some_aside = not aside.isEmpty()
    hits = hits.drop("tokens", "plain")
    hits = materialize(hits, "window-hits") if some_aside else hits
    joined = hits.join(sized(items.where("not aside").drop("aside")), "window")
    if some_aside:  # common windows of the pairs that share another one
        joined = materialize(joined, "window-pairs")
        pairs = joined.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), "item_key").distinct().join(sized(aside), "item_key").withColumnRenamed("window", "_window")
        more = hits.join(pairs, (hits["text_key"] == pairs["_key"]) & (hits["window"] == pairs["_window"]) & hits[id_col].eqNullSafe(pairs["_id"])).drop("_id", "_key", "_window")
        joined = joined.unionByName(more)
    joined = joined.withColumn("shift", F.col("position") - F.col("item_position"))
    keys = [id_col, "text_key", "item_key", "of_item", "of_template"]
    window = F.struct(F.col("item_position").alias("place"), "plain", F.col("item_slots").alias("item"), F.col("slots").alias("own"), "weight")
    judged = judge_alignments(joined.groupBy(*keys, "shift").agg(F.collect_set(window).alias("windows")).drop("shift"), keys)
    found = judged.groupBy(*keys).agg(F.flatten(F.collect_set("places")).alias("places"), F.flatten(F.collect_set("template_places")).alias("template_places"), F.max("n_aligned").alias("n_aligned"), F.max("run").alias("run"), F.max("exact").alias("exact"))
    found = found.withColumns({c: once_a_place(F.col(c)) for c in ("places", "template_places")})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda done, x: done + x["weight"])
    share = F.greatest(F.when(F.col("of_item") > 0, total("places") / F.col("of_item")), F.when(F.col("of_template") > 0, total("template_places") / F.col("of_template")))
    # sums of weights in another order may differ in their last digits
    found = found.select(id_col, "text_key", "item_key", F.size("places").alias("n_matched"), F.round(share, 9).alias("coverage"), "n_aligned", "run", "exact").where((F.col("coverage") >= 0.5) | (F.round("run", 9) >= RUN_WINDOWS))
    named = keyed_items(benchmark, item_col, text_col).select(item_col, "item_key").distinct()
    return found.drop("run").join(named, "item_key").select(id_col, "text_key", item_col, "n_matched", "n_aligned", "exact", "coverage")


def once_a_place(places):
    """Each place once, with its largest weight."""
    return bind(F.array_sort(places), lambda p: F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1)["place"] != x["place"], F.lit(True))))


def judge_alignments(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Places (with weights) of the windows that count, those by templates among them, their number and sum, and whether all is exact, of each alignment."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in aligned.select(*keys).schema.fields]
    weighed = pa.list_(pa.struct([("place", pa.int32()), ("weight", pa.float64())]))

    def weighed_places(windows):
        places, template, exact = judge(windows)
        weight = {(w["place"], w["plain"]): w["weight"] for w in windows}
        all_of = [{"place": p, "weight": weight.get((p, True)) or weight[p, False]} for p in places]
        return all_of, [{"place": p, "weight": weight[p, False]} for p in template], len(places), sum(x["weight"] for x in all_of), exact

    def run(batches):
        for batch in batches:
            judged = [weighed_places(w) for w in batch.column(len(keys)).to_pylist()]
            made = [pa.array([j[k] for j in judged], type=t) for k, t in enumerate((weighed, weighed, pa.int32(), pa.float64(), pa.bool_()))]
            out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *made], names=[*keys, "places", "template_places", "n_aligned", "run", "exact"])
            yield out.filter(pc.greater(out.column(len(keys) + 2), 0))

    place = "array<struct<place:int,weight:double>>"
    return aligned.select(*keys, "windows").mapInArrow(run, ", ".join([*fields, f"places {place}, template_places {place}, n_aligned int, run double, exact boolean"]))


def judge(windows: list[dict]) -> tuple[list[int], list[int], bool]:
    """Places that count, those by templates, and whether all windows are exact, of the windows of one alignment."""
    template = [w for w in windows if not w["plain"]]
    counts = Counter(p for w in template for p in set(zip(w["item"], w["own"])))
    options: dict[str, dict[str, int]] = {}
    for (item, own), n in counts.items():
        options.setdefault(item, {})[own] = n
    chosen: dict[str, str] = {}
    for item, owns in options.items():
        top = [own for own, n in owns.items() if n == max(owns.values())]
        if item in top or len(top) == 1:
            chosen[item] = item if item in top else top[0]
    owners = Counter(own for item, own in chosen.items() if item[:1] == "@")
    agreed = {(item, own) for item, own in chosen.items() if item == own or item[:1] != "@" or owners[own] == 1}
    kept = {w["place"] for w in template if w["item"] == w["own"] or agreed.issuperset(zip(w["item"], w["own"]))}
    return sorted(kept | {w["place"] for w in windows if w["plain"]}), sorted(kept), all(item == own for item, own in counts)


def remove_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_PLAIN, common: int = COMMON) -> DataFrame:
    """The rows whose text no item contaminates."""
    bad = materialize(contaminated_pairs(df, benchmark, id_col, text_col, least=least, common=common).select("text_key").distinct(), "contaminated")
    key = fresh_name(df, "text_key")
    bad = bad.withColumnRenamed("text_key", fresh_name(df, "bad_text_key"))
    keyed = df.withColumn(key, F.xxhash64(text_col))
    return keyed.join(bad, keyed[key] == bad[bad.columns[0]], "left_anti").drop(key)
