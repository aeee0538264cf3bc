"""Near copies by Jaccard similarity of five-word shingles: `LEAST` or more is a near copy. For the pipeline.

Texts with equal words are one node. SimHash comes first: nodes whose fingerprints are within two bits, found by the
generalised pigeonhole search of `simhash.py`, are compared by their whole sets of shingles, so that no link is wrong.

Near copies of 0.8 differ by some 10 of 64 bits, so what SimHash leaves apart is searched further. The smallest values
of a node's shingles under `BANDS` x `ROWS` hash functions give one key a band; two nodes of similarity s share a key
with probability 1 - (1 - s**ROWS)**BANDS, which is over 0.99999 at 0.8. Nodes that share a key and are still in
different components are compared.

Buckets have no limit and are not compared pair by pair. Each node is compared with the first node that it shares most
keys with, and then, where a bucket still holds several components, with two nodes of its largest one. What is still
apart after that takes an exact way: of the texts of such buckets all pairs in different components are compared that
can be similar by their rarest shingles (prefix and position filters). What is left out is within a component already
or can't be similar, so that the components are those of all pairs that are within two bits or share a key.

Defined results: words are split at ASCII white space, ASCII letters count as lower case; a text of fewer than five
words is one shingle; texts without words (or null) are copies of each other; a null id gets its group's smallest id,
or null if the group has none; rows with one id and unlike texts are different documents; an empty table gives an empty
table. A very long text takes some 40 bytes of memory a word beside the text. Equal words are told by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..operators.graph import connected_components
from .common import discard, fresh_name, hashed_words, map_texts, materialize, slices
from .simhash import fingerprint, near_links

WORDS, BANDS, ROWS = 5, 24, 4
#: Similarity of near copies, as a fraction of whole numbers.
LEAST = (4, 5)
_DRAWN = np.random.default_rng(7).integers(0, 1 << 63, size=(3, BANDS * ROWS), dtype=np.uint64)
SEEDS, FACTORS, WEIGHTS = _DRAWN[0][:, None], _DRAWN[1][:, None] * np.uint64(2) + np.uint64(1), (_DRAWN[2] * np.uint64(2) + np.uint64(1)).reshape(BANDS, ROWS)
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> TURN)) * MIX
    return h ^ (h >> TURN)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted hashes of the different shingles of a text, given its words' hashes."""
    k = min(WORDS, len(words))
    if not k:
        return words
    h = np.full(len(words) - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        h = mixed(h) + words[j : len(words) - k + 1 + j]
    return np.unique(mixed(h))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key a band, of the smallest values of the hashes under the band's functions."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[at : at + 2048] ^ SEEDS) * FACTORS).min(axis=1))
    keys = ((low ^ (low >> np.uint64(29))).reshape(BANDS, ROWS) * WEIGHTS).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def node_of(words: np.ndarray) -> int:
    """A number for the whole sequence of words."""
    if not len(words):
        return 0
    place = np.cumprod(np.full(len(words), MIX | np.uint64(1), dtype=np.uint64))
    total = np.array([(mixed(words) * place).sum(dtype=np.uint64) + np.uint64(len(words))], dtype=np.uint64)
    return int(mixed(total).view(np.int64)[0])


def sketch(texts: pa.Array) -> list[list]:
    """Node, number of different shingles, band keys and SimHash fingerprint of each text."""
    words, begin = hashed_words(texts)
    nodes, sizes, bands = [], [], []
    for i in range(len(texts)):
        own = words[begin[i] : begin[i + 1]]
        hashes = shingles(own)
        nodes.append(node_of(own))
        sizes.append(len(hashes))
        bands.append(band_keys(hashes) if len(own) else [])
    return [nodes, sizes, bands, [fingerprint(t.as_py()) for t in texts]]


def sketches(df: DataFrame, text_col: str) -> DataFrame:
    """Add node (long), n_shingles, bands and fingerprint (long)."""
    fields = [T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fingerprint", T.LongType())]
    return map_texts(df, text_col, fields, lambda: sketch, arrow=True)


def alike(one: np.ndarray, other: np.ndarray) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common * LEAST[1] >= (len(one) + len(other) - common) * LEAST[0]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose texts are near copies by all their shingles. texts: node, text."""

    def run(batches):
        last: dict[str, tuple] = {"a": (None, None), "b": (None, None)}

        def sets_of(side, nodes, texts):
            """Shingles of each text; a text like the one before is not cut again."""
            new = [i for i, n in enumerate(nodes) if n != (nodes[i - 1] if i else last[side][0])]
            words, begin = hashed_words(texts.take(pa.array(new, pa.int64())))
            own, k = [], 0
            for i, n in enumerate(nodes):
                if k < len(new) and new[k] == i:
                    last[side] = (n, shingles(words[begin[k] : begin[k + 1]]))
                    k += 1
                own.append(last[side][1])
            return own

        for batch in batches:
            for at, n in slices(batch.column(3), 64):
                part = batch.slice(at, n)
                a, b = (sets_of(side, part.column(k).to_pylist(), part.column(k + 2)) for k, side in enumerate("ab"))
                keep = pa.array([alike(x, y) for x, y in zip(a, b)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_sizes(one: str, other: str):
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(one, other) * LEAST[1] >= F.greatest(one, other) * LEAST[0]


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of nodes within two bits that connect all such nodes of near sizes; nodes: node, n, fingerprint.

    The nodes of a fingerprint are paired with the first of them, and the first ones of fingerprints within two bits.
    """
    firsts = materialize(nodes.groupBy("fingerprint").agg(F.min(F.struct("node", "n")).alias("first")), "similar-prints")
    same = nodes.join(firsts, "fingerprint").where(F.col("node") != F.col("first.node")).where(near_sizes("n", "first.n"))
    near = near_links(firsts.select(F.col("fingerprint").alias("node")))
    of = lambda name: firsts.select(F.col("fingerprint").alias(name), F.col("first").alias(f"first_{name}"))
    across = near.distinct().join(of("a"), "a").join(of("b"), "b").where(near_sizes("first_a.n", "first_b.n"))
    return pair_of(same, "node", "first.node").unionByName(pair_of(across, "first_a.node", "first_b.node")).distinct()


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (hash of the text), node, root (a node: the same for all rows of a component) and component id of every row."""
    keyed = df.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("text_key"))
    rows = materialize(sketches(keyed, text_col).drop(text_col), "sketches")
    nodes = rows.groupBy("node").agg(F.min(id_col).alias("rank"), F.min("text_key").alias("text_key"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("fingerprint").alias("fingerprint"))
    nodes = materialize(nodes, "similar-nodes")
    compared = materialize(simhash_pairs(nodes.select("node", "n", "fingerprint")), "similar-pairs")
    dealt = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = dealt.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = materialize(dealt.join(buckets, "key"), "similar-buckets")
    met = members.select("node").unionByName(compared.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    shared = met.join(nodes, "node").select("node", "text_key")
    texts = keyed.select("text_key", F.col(text_col).alias("text")).join(shared.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])
    texts = materialize(texts.join(shared, "text_key").select("node", "text"), "similar-texts")
    ranks = nodes.select("node", "rank")

    # nodes within two bits
    links = materialize(verified(compared, texts), "similar-links")
    roots = materialize(all_roots(ranks, links), "similar-roots")
    # then each node with the first node that it shares most keys with, unless the two are together already
    stars = members.where(F.col("node") != F.col("first.node")).where(near_sizes("n", "first.n"))
    best = stars.groupBy("node", F.col("first.node").alias("hub")).count().groupBy("node").agg(F.max(F.struct("count", "hub")).alias("_m"))
    best = best.select("node", F.col("_m.hub").alias("hub")).join(roots.select("node", "root"), "node")
    best = best.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub").where("root != hub_root")
    pairs = materialize(pair_of(best, "node", "hub").distinct().join(compared, ["a", "b"], "left_anti"), "similar-pairs")
    more = materialize(verified(pairs, texts), "similar-links")
    compared, links = compared.unionByName(pairs), links.unionByName(more)
    roots = materialize(all_roots(ranks, links), "similar-roots")
    # then those of a bucket that are not in its largest component with two nodes of that
    for pick in (F.min, F.max):
        apart = apart_in_buckets(members, roots)
        main = F.when(F.col("root") == F.col("main"), F.struct("node", "n"))
        hubs = apart.groupBy("key").agg(pick(main).alias("hub"))
        pairs = apart.where("root != main").join(hubs, "key").where(near_sizes("n", "hub.n"))
        pairs = materialize(pair_of(pairs, "node", "hub.node").distinct().join(compared, ["a", "b"], "left_anti"), "similar-pairs")
        more = materialize(verified(pairs, texts), "similar-links")
        compared, links = compared.unionByName(pairs), links.unionByName(more)
        if more.limit(1).count():
            roots = materialize(all_roots(ranks, links), "similar-roots")
        discard(apart)
    # then all that are still apart and can be similar by the order of their shingles
    apart = apart_in_buckets(members, roots)
    pairs = materialize(prefix_pairs(apart, texts).join(compared, ["a", "b"], "left_anti"), "similar-pairs")
    more = materialize(verified(pairs, texts), "similar-links")
    if more.limit(1).count():
        roots = materialize(all_roots(ranks, links.unionByName(more)), "similar-roots")
    discard(texts, members, apart)
    return rows.select(id_col, "text_key", "node").join(roots.withColumnRenamed("rank", "component_id"), "node").select(id_col, "text_key", "node", "root", "component_id")


def pair_of(df: DataFrame, one: str, other: str) -> DataFrame:
    return df.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))


def all_roots(ranks: DataFrame, links: DataFrame) -> DataFrame:
    """node, root and smallest rank of the component of every node; nodes without links are their own roots."""
    linked = connected_components(ranks, links).select("node", "root", F.col("rank").alias("low"))
    found = ranks.join(linked, "node", "left")
    return found.select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("rank")).otherwise(F.col("low")).alias("rank"))


def apart_in_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, n, root and main (the root of most of the bucket's nodes) in buckets with several components."""
    placed = materialize(members.select("key", "node", "n").join(roots.select("node", "root"), "node"), "similar-placed")
    split = placed.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    apart = materialize(placed.join(split, "key"), "similar-apart")
    discard(placed)
    return apart


def shingle_rows(texts: DataFrame) -> DataFrame:
    """node and token of every different shingle. texts: node, text."""

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1), 256):
                part = batch.slice(at, n)
                words, begin = hashed_words(part.column(1))
                for i in range(n):
                    own = shingles(words[begin[i] : begin[i + 1]])
                    yield pa.RecordBatch.from_arrays([pa.repeat(part.column(0)[i], len(own)), pa.array(own.view(np.int64))], names=["node", "token"])

    return texts.select("node", "text").mapInArrow(run, "node long, token long")


def prefix_pairs(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: all pairs of nodes in different components, one of them outside the main one of a bucket, that can be near copies.

    Shingles are put in one order, rarest first. Sets of similarity 4/5 share a shingle among the first fifth of each,
    and what follows the first one they share must hold the overlap that their sizes ask for. Most shingles that all of
    a family of texts share come late in that order, so that they bring few texts together that are not similar.
    """
    of = materialize(apart.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("outside")), "similar-outside")
    tokens = materialize(shingle_rows(texts.join(of.select("node"), "node", "left_semi")), "similar-tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    ranked = tokens.join(often, "token", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("often", "token"))).where("often > 1")
    first = ranked.join(of, "node").where(F.col("place") * LEAST[1] <= F.col("n") * (LEAST[1] - LEAST[0]) + LEAST[1])
    first = materialize(first.select("node", "n", "root", "outside", "token", "place"), "similar-prefixes")
    x = first.where("outside").select("token", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("root").alias("x_root"), F.col("place").alias("x_place"))
    overlap = (LEAST[0] + LEAST[1]) * (1 + F.least(F.col("n") - F.col("place"), F.col("x_n") - F.col("x_place"))) >= LEAST[0] * (F.col("n") + F.col("x_n"))
    found = x.join(first, "token").where("x_root != root and (not outside or x < node)").where(near_sizes("x_n", "n") & overlap)
    discard(tokens)
    return pair_of(found, "x", "node").distinct()


def keep_one_of_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near copies: of each component one row, the one with the smallest id.

    A row is known by its id and its text, so that rows with one id and unlike texts are different documents. Of rows
    with the smallest id and different texts of one component the one whose text hashes lowest stays, of repeated rows
    one. A row with a null id stays where its component has no id.
    """
    found = materialize(similar_groups(df, id_col, text_col), "similar-found")
    rows = found.groupBy(id_col, "text_key", "root").agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_key", "n")).alias("_m"))
    own_id, own_key, n = (fresh_name(df, c) for c in ("kept_id", "kept_key", "kept_n"))
    best = materialize(best.select(F.col("_m.id").alias(own_id), F.col("_m.text_key").alias(own_key), F.col("_m.n").alias(n)), "similar-kept")
    key = fresh_name(df, "text_key")
    keyed = df.withColumn(key, F.xxhash64(text_col))
    same = keyed[id_col].eqNullSafe(best[own_id]) & (keyed[key] == best[own_key])
    once = keyed.join(best.where(F.col(n) == 1), same, "left_semi")
    repeated = keyed.join(best.where(F.col(n) > 1), same, "left_semi").dropDuplicates([id_col, key])
    return once.unionByName(repeated).drop(key)
