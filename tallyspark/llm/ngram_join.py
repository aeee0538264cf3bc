"""Similarity join on word n-grams: documents whose sets of shingles have a Jaccard similarity of `LEAST` percent or more.

Rare-first prefix filter: the shingles of a set are put in one order over all sets, rarest first, and two sets that link
share a shingle among the first n - ceil(0.9 n) + 1 of each. Sets are joined on those. A pair stays if its sizes allow
the similarity (length), if what follows the shared shingle is long enough (position), and if the sets behind it can
have enough in common by how many shingles of each class of hashes they hold (suffix). A pair that stays is verified
once, by the whole sets. None of the filters drops a pair that links at the first shingle that it shares.

The order is by counts of shingles in `COUNTERS` counters over all sets, and by hash. It need not be exact: any one
order gives the same links, and a shared counter only makes a shingle look more frequent. The counters have a fixed size
and are sent to all tasks.

Documents with equal sets are one node. The sets that share a prefix shingle are not compared pair by pair: each is
first compared with the first one that it shares most prefix shingles with; where a shingle's sets still are in several
components, with the smallest and the largest of the main one; and then all pairs that the filters leave and that are
still apart, of which one lies outside the main component, are compared. Pairs that are left out are in one component
already, so the components are those of all links. A family of very many sets just below the limit still makes a pair
of each two that pass the filters.

Defined results: A-Z count as lower case; a text of one or two words is one shingle; a text without words (or null) has
size 0 and is alone, its component being its own id; a null id gets its component's smallest id, or null if there is
none; rows with one id and unlike texts are different documents, repeated rows are one; an empty table gives an empty
table; columns other than id and text are ignored. A very long text takes some 40 bytes of memory a word beside the
text. Equal words and shingles are told by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.graph import connected_components
from .common import discard, hashed_words, map_texts, materialize, slices

WORDS, LEAST = 3, 90
#: Counters of shingles; a power of two.
COUNTERS = 1 << 20
#: Counters that are added up as one row.
CHUNK = 1 << 14
CLASSES = 8
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> TURN)) * MIX
    return h ^ (h >> TURN)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of each text; none without words."""
    words, begin = hashed_words(texts)
    sets = []
    for i in range(len(texts)):
        own = words[begin[i] : begin[i + 1]]
        k = min(WORDS, len(own))
        h = np.full(max(len(own) - k + 1, 0) if k else 0, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            h = mixed(h) + own[j : j + len(h)]
        sets.append(np.unique(mixed(h)))
    return sets


def set_numbers(texts: pa.Array) -> list:
    """Node (a number of the whole set) and size of each text's set."""
    sets = shingle_sets(texts)
    total = np.array([mixed(s * MIX).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    return [pa.array(mixed(total + size.astype(np.uint64)).view(np.int64)), pa.array(size)]


def counter_sums(texts: DataFrame, counters: int) -> np.ndarray:
    """How many shingles of all sets fall on each counter: sums of each task first, then of chunks of counters."""
    chunk = min(CHUNK, counters)

    def run(batches):
        counts = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            for at, n in slices(batch.column(0), 256):
                every = np.concatenate(shingle_sets(batch.column(0).slice(at, n)))
                counts += np.bincount((every & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
        parts = np.minimum(counts, 2**31 - 1).astype(np.int32).reshape(-1, chunk)
        for k in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([parts[k]], pa.list_(pa.int32()))], names=["chunk", "n"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                totals[k] = np.minimum(totals.get(k, 0) + np.asarray(n.values, dtype=np.int64), 2**31 - 1)
        for k, n in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n.astype(np.int32)], pa.list_(pa.int32()))], names=["chunk", "n"])

    schema = "chunk long, n array<int>"
    sums = texts.select("text").mapInArrow(run, schema).repartition("chunk").mapInArrow(add, schema).toArrow()
    out = np.zeros((counters // chunk, chunk), dtype=np.int32)
    for k, n in zip(sums.column(0).to_pylist(), sums.column(1)):
        out[k] = np.asarray(n.values)
    return out.reshape(-1)


def ordered(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the one order of all shingles, rarest first."""
    often = counts[(own & np.uint64(len(counts) - 1)).astype(np.int64)]
    return own[np.lexsort((own, often))]


def prefix_size(n):
    """Of how many first shingles two sets that link share one, by the size of either."""
    return n - (LEAST * n + 99) // 100 + 1


def suffix_classes(own: np.ndarray, k: int) -> np.ndarray:
    """For each of the first k places, the numbers of shingles behind it by class, modulo 256, as one byte a class."""
    kind = (own >> np.uint64(61)).astype(np.int64)
    after = np.bincount(kind, minlength=CLASSES)[None, :] - np.cumsum(np.eye(CLASSES, dtype=np.int64)[kind[:k]], axis=0)
    return np.ascontiguousarray(after & 255, dtype=np.uint8).view(np.int64)[:, 0]


def prefixes(texts: DataFrame, sent) -> DataFrame:
    """node, n, token, place (from 1) and suffix of each prefix shingle. texts: node, text; sent: the counters."""

    def run(batches):
        for batch in batches:
            for at, m in slices(batch.column(1), 256):
                part = batch.slice(at, m)
                node, columns = part.column(0).to_numpy(), []
                for i, s in enumerate(shingle_sets(part.column(1))):
                    k = prefix_size(len(s))
                    own = ordered(s, sent.value)
                    columns.append((np.full(k, node[i]), np.full(k, len(s)), own[:k].view(np.int64), np.arange(1, k + 1), suffix_classes(own, k)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns)], names=["node", "n", "token", "place", "suffix"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, token long, place long, suffix long")


def sizes_allow(one: Column, other: Column) -> Column:
    """Length filter: the smaller set is large enough for the larger one."""
    return 100 * F.least(one, other) >= LEAST * F.greatest(one, other)


def suffixes_allow(x: str, y: str) -> Column:
    """Position and suffix filter of two prefix rows: one shared shingle and what can be common behind it make the overlap.

    Two suffixes differ in each class by at least the difference of its counts; of counts modulo 256 the nearest.
    """
    apart = F.lit(0)
    for k in range(CLASSES):
        byte = lambda side: F.shiftrightunsigned(F.col(f"{side}.suffix"), 8 * k).bitwiseAND(F.lit(255))
        gap = F.abs(byte(x) - byte(y))
        apart = apart + F.least(gap, 256 - gap)
    behind = lambda side: F.col(f"{side}.n") - F.col(f"{side}.place")
    common = 1 + F.least(behind(x), behind(y), F.floor((behind(x) + behind(y) - apart) / 2))
    return (100 + LEAST) * common >= LEAST * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def pair_of(df: DataFrame, one: str, other: str) -> DataFrame:
    return df.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b that link by their whole sets. texts: node, text."""

    def run(batches):
        last: dict[str, tuple] = {"a": (None, None), "b": (None, None)}

        def sets_of(side, nodes, texts):
            """Sets of the texts; one like the one before is not made again."""
            new = [i for i, n in enumerate(nodes) if n != (nodes[i - 1] if i else last[side][0])]
            made, own = iter(shingle_sets(texts.take(pa.array(new, pa.int64())))), []
            fresh = set(new)
            for i, n in enumerate(nodes):
                if i in fresh:
                    last[side] = (n, next(made))
                own.append(last[side][1])
            return own

        for batch in batches:
            for at, m in slices(batch.column(3), 64):
                part = batch.slice(at, m)
                a, b = (sets_of(side, part.column(k).to_pylist(), part.column(k + 2)) for k, side in enumerate("ab"))
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)]
                keep = pa.array([100 * c >= LEAST * (len(x) + len(y) - c) for x, y, c in zip(a, b, common)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def roots_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, root and smallest id (rank) of each node's component."""
    linked = connected_components(nodes.select("node", "rank"), links).select("node", "root", F.col("rank").alias("low"))
    found = nodes.select("node", "rank").join(linked, "node", "left")
    return found.select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("rank")).otherwise(F.col("low")).alias("rank"))


def apart(first: DataFrame, roots: DataFrame) -> DataFrame:
    """The prefix rows of shingles whose sets are in several components, with root and main (the root of most of them)."""
    placed = materialize(first.join(roots.select("node", "root"), "node"), "join-placed")
    split = placed.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    out = materialize(placed.join(split, "token"), "join-apart")
    discard(placed)
    return out


def similarity_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """id, n_shingles, component_id and node (a number of the set) of every row."""
    fields = [T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType())]
    keyed = df.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    rows = materialize(map_texts(keyed, "text", fields, lambda: set_numbers, arrow=True).drop("text"), "join-rows")
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_key")
    sets = rows.where("n_shingles > 0").groupBy("node").agg(F.min(own).alias("_m"), F.first("n_shingles").alias("n"))
    nodes = materialize(sets.select("node", "n", F.col("_m.id").alias("rank"), F.col("_m.text_key").alias("key")), "join-nodes")
    same = keyed[id_col].eqNullSafe(nodes["rank"]) & (keyed["text_key"] == nodes["key"])
    texts = materialize(keyed.join(nodes, same).select("node", "text").dropDuplicates(["node"]), "join-texts")
    sent = df.sparkSession.sparkContext.broadcast(counter_sums(texts, counters))
    whole = materialize(prefixes(texts, sent), "join-prefixes")
    shared = whole.groupBy("token").agg(F.count("*").alias("sets"), F.min("node").alias("hub")).where("sets > 1").drop("sets")
    first = materialize(whole.join(shared, "token"), "join-first")
    discard(whole)

    # each set with the first set that it shares most prefix shingles with
    stars = first.where("node != hub").groupBy("node", "hub").count()
    best = stars.groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    sized = best.join(nodes.select("node", "n"), "node").join(nodes.select(F.col("node").alias("hub"), F.col("n").alias("of_hub")), "hub")
    compared = materialize(pair_of(sized.where(sizes_allow(F.col("n"), F.col("of_hub"))), "node", "hub"), "join-pairs")
    links = materialize(verified(compared, texts), "join-links")
    roots = materialize(roots_of(nodes, links), "join-roots")
    first = first.drop("hub")
    # then those outside the main component of a shingle with two sets of that, and at last with all sets left
    for pick in (F.min, F.max, None):
        left = apart(first, roots)
        if pick is not None:
            main = F.when(F.col("root") == F.col("main"), F.struct("n", "node", "root", "place", "suffix"))
            others = left.groupBy("token").agg(pick(main).alias("y")).where("y is not null").select("token", "y.*")
        else:
            others = left
        x = left.where("root != main").alias("x")
        y = others.alias("y")
        once = F.lit(True) if pick is not None else (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root"))
        found = x.join(y, same & once & sizes_allow(F.col("x.n"), F.col("y.n")) & suffixes_allow("x", "y"))
        pairs = pair_of(found.select(F.col("x.node").alias("one"), F.col("y.node").alias("other")), "one", "other")
        pairs = materialize(pairs.join(compared, ["a", "b"], "left_anti"), "join-pairs")
        more = materialize(verified(pairs, texts), "join-links")
        compared, links = compared.unionByName(pairs), links.unionByName(more)
        if more.limit(1).count():
            roots = materialize(roots_of(nodes, links), "join-roots")
        discard(left)
    discard(texts, first)
    found = rows.join(roots.select("node", F.col("rank").alias("component_id")), "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col(id_col)).otherwise(F.col("component_id"))
    return found.select(id_col, "n_shingles", own.alias("component_id"), "node")
