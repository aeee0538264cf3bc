"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of the XXH64 hashes of its word shingles have it. Equal fingerprints
are collapsed first, so that copies never meet each other. Correlated bits are then grouped into partitions, and each
partition gets its own threshold: if the thresholds add up to `max_bits` - partitions + 1, two fingerprints within
`max_bits` are within the threshold in at least one partition. Dynamic programming chooses the thresholds (-1: the
partition is not probed; 0: equal; 1: equal but for one bit) with the fewest keys and expected candidates, which are
counted over all fingerprints. Fingerprints that share a key are verified.

In a bucket of up to `BUCKET` fingerprints all pairs are compared. Larger ones are searched without pairs, and as
exactly: two fingerprints are within two bits if and only if some 64-bit value is within one bit of both, so each
fingerprint of a large bucket names the 65 values around it and is linked to the smallest that names the same value;
at most 65 different fingerprints can name one value.

Defined results: a text without words (or null) has fingerprint 0, linked like any other; rows with equal ids are
each returned; a null id gets its group's smallest id, or null if the group has none; ties go to the smallest id;
columns named like an output column are replaced; an empty table gives an empty table. A very long text is read in
pieces of a million characters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.graph import connected_components
from .common import fresh_name, map_texts, materialize, pieces

BITS = 64
#: Largest bucket in which all pairs are compared; larger ones take the exact way without pairs.
BUCKET = 48


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    digest, ones, n, tail = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), 0, []
    for piece in pieces(text or ""):
        tokens = tail + piece.encode().lower().split()  # of bytes: ASCII letters and ASCII spaces only
        tail = tokens[max(len(tokens) - words + 1, 0) :]  # begins the next piece's first shingles
        if len(tokens) < words:
            tail = tokens
            continue
        joined = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens])
        starts = np.concatenate([[0], ends[:-1]])[: len(tokens) - words + 1].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)
        n += len(hashes)
        ones += set_bits(hashes)
    if not n:  # fewer words than a shingle has
        if not tail:
            return 0
        n, ones = 1, set_bits(np.array([digest(b" ".join(tail), seed)], dtype=np.uint64))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """Add the fingerprint (long) of a text column."""
    return map_texts(df, text_col, [T.StructField(out, T.LongType())], lambda: lambda texts: [[fingerprint(t, words) for t in texts]])


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, for all i and j; one partial table a task."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(raw), 4096):
                bits = np.unpackbits(raw[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total += bits.T @ bits
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total.ravel()[k])], names=["cell", "n"])

    out = np.zeros(BITS * BITS)
    for r in nodes.select("node").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Split the bits into parts of nearly equal size, so that each holds bits that go together."""
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(sorted(free), key=lambda b: tie[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: tie[b, group].sum()))
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit number."""
    return int(np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0])


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a partition, that add up to `total` at the least cost: dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (spent, chosen) in best.items():
            for t, c in cost.items():
                if done + t not in step or spent + c < step[done + t][0]:
                    step[done + t] = (spent + c, [*chosen, t])
        best = step
    return best.get(total, (math.inf, []))


def plan_partitions(nodes: DataFrame, n: int, max_bits: int) -> list[tuple[list[int], int]]:
    """Bits and threshold of each probed partition, by counts over all fingerprints."""
    together = bit_counts(nodes)
    p = np.diag(together) / n
    unlike = 2 * p * (1 - p)
    options = {m: group_bits(together, n, m) for m in range(max(1, (max_bits + 2) // 2), max_bits + 3)}
    keys = [F.struct(F.lit(m * BITS + i).alias("part"), F.col("node").bitwiseAND(F.lit(mask_of(g))).alias("value")) for m, groups in options.items() for i, g in enumerate(groups)]
    sizes = nodes.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.part", "k.value").count()
    pairs = {r["part"]: r["pairs"] for r in sizes.groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m, groups in options.items():
        costs = []
        for i, g in enumerate(groups):
            equal = pairs.get(m * BITS + i, 0.0)
            one_off = equal * (1 + sum(unlike[b] / max(1 - unlike[b], 1e-9) for b in g))
            costs.append({-1: 0.0, 0: n + equal, 1: n * len(g) + one_off})
        cost, chosen = allocate(costs, max_bits - m + 1)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def probe_keys(plan: list[tuple[list[int], int]]) -> Column:
    """Array of (part, value) keys of a fingerprint."""
    keys = []
    for i, (bits, threshold) in enumerate(plan):
        for j in [None] if threshold == 0 else bits:
            keys.append(F.struct(F.lit(i * (BITS + 1) + (BITS if j is None else j)).alias("part"), F.col("node").bitwiseAND(F.lit(mask_of([b for b in bits if b != j]))).alias("value")))
    return F.array(*keys)


def near_links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """a, b: links that connect all fingerprints within max_bits of each other (large buckets: a spanning part of them)."""
    if max_bits != 2:
        raise ValueError("the way through large buckets is exact for two bits")
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    keyed = nodes.select("node", F.explode(probe_keys(plan_partitions(nodes, n, max_bits))).alias("k")).select("node", "k.part", "k.value")
    sizes = materialize(keyed.groupBy("part", "value").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    members = materialize(keyed.join(sizes, ["part", "value"]), "bucket-members")
    lists = members.where(F.col("size") <= BUCKET).groupBy("part", "value").agg(F.sort_array(F.collect_list("node")).alias("all"))
    near = F.expr(f"flatten(transform(all, (x, i) -> transform(filter(all, (y, j) -> j > i and bit_count(x ^ y) <= {max_bits}), y -> struct(x as a, y as b))))")
    small = lists.select(F.explode(near).alias("p")).select("p.a", "p.b")
    around = F.array(F.col("node"), *[F.col("node").bitwiseXOR(F.lit(mask_of([b]))) for b in range(BITS)])
    named = members.where(F.col("size") > BUCKET).select("node").distinct().select("node", F.explode(around).alias("near"))
    large = named.groupBy("near").agg(F.collect_list("node").alias("all")).where("size(all) > 1")  # at most 65 each
    large = large.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b")
    return small.unionByName(large)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, words: int = 3) -> DataFrame:
    """id, fingerprint (long), group (a fingerprint: the same for all rows of a component) and component id of every row."""
    rows = materialize(fingerprints(df.select(id_col, text_col), text_col, words=words).select(id_col, "fingerprint"), "fingerprints")
    nodes = materialize(rows.groupBy(F.col("fingerprint").alias("node")).agg(F.min(id_col).alias("rank")), "distinct-fingerprints")
    roots = connected_components(nodes, near_links(nodes, max_bits)).select("node", "root", F.col("rank").alias("low"))
    of = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"), F.coalesce("low", "rank").alias("component_id"))
    of = materialize(of, "components")
    return rows.join(of, rows["fingerprint"] == of["node"]).select(id_col, "fingerprint", "group", "component_id")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each component one row, the one with the smallest id.

    A row is known by its id and fingerprint, so that rows with one id and unlike texts are different documents. Of
    rows with the smallest id and different fingerprints of one component the lowest fingerprint stays, of repeated
    rows one. A row with a null id stays where its component has no id.
    """
    found = near_duplicates(df, id_col, text_col)
    own_id, own_print, mark = (fresh_name(df, c) for c in ("kept_id", "kept_fingerprint", "own_fingerprint"))
    best = found.groupBy("group").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "fingerprint")).alias("_m"))
    best = best.select(F.col("_m.id").alias(own_id), F.col("_m.fingerprint").alias(own_print))
    marked = fingerprints(df, text_col, mark)
    same = marked[id_col].eqNullSafe(best[own_id]) & (marked[mark] == best[own_print])
    return marked.join(best, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)
