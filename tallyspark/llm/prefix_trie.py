"""Prefix trie of conversations: which beginnings they share, and how many words sharing them saves.

Conversations are cut into segments of `WIDTH` turns, each with a key of all turns before it, and equal segments become
one row with a count. Rows are dealt by ranges of (band, key, turns), so that a shard holds neighbours. In a shard the
turns are a padded matrix, sorted by numpy's lexsort; a mask of changes to the row before, OR-accumulated over the
columns, marks where a node starts at each depth, and reduceat sums up the rows of each node. Each shard knows the last
row before it and the first behind it: so a node on a border is counted as new once, and its parts are recombined by
its key. What lies below the end of a segment is summed up over the trie of segments, from each to its ancestors at
distances 1, 2, 4 and so on, so that a long conversation takes few rounds. No conversation, copy or node is gathered as
a whole: copies are one row, and the members that end at a node are hashed as a sorted stream.

Defined results: turns are ordered by number, a null number first, and those of one number by a hash of role and text;
null roles and texts are empty; rows with a null conversation id belong to no conversation and are left out; repeated
rows are turns of their own; an empty table gives an empty table; columns other than the four named are ignored. A very
long text leaves its hash and its number of words only. Equal turns and beginnings are told by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, materialize

#: Turns of a segment, and rows of a shard on average.
WIDTH, SHARD = 64, 20_000
#: The query's conversations begin like the first of each so many, by fewer than so many turns.
FAMILY, MOST_HEAD = 20, 4
PAD = np.iinfo(np.int64).min
NODE = "depth long, key long, parent_key long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, edge boolean, open boolean"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0), turn_id (hash of role and text) and words of each turn.

    Turns are dealt by ranges and written; a turn's place is the turns of its conversation in the ranges before its own
    and its place within its range, so that a conversation with most of the turns is many tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    turn_id = F.xxhash64(F.coalesce(F.col(role_col), F.lit("")), text)
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), turn_id.alias("turn_id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    dealt = materialize(rows.repartitionByRange("conv_id", "turn", "turn_id").withColumn("range", F.spark_partition_id()), "turns")
    sizes = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "turn_id")).cast("long") - 1
    placed = dealt.withColumn("at", at).join(starts, ["conv_id", "range"])
    return placed.select("conv_id", (F.col("start") + F.col("at")).alias("place"), "turn_id", "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin with the head of their family's first one, and all conversation ids.

    Conversation c gets the first h turns of conversation c - c % FAMILY, as far as they exist, and then its own turns
    after its first h, h being the CRC-32 of its decimal id modulo MOST_HEAD. turns: as numbered_turns gives them.
    """
    turns = materialize(turns, "numbered-turns")
    heads = turns.where(F.col("place") < MOST_HEAD - 1).groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "turn_id", "words"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).cast("int")
    convs = turns.select("conv_id").distinct().withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % FAMILY})
    none = F.array().cast("array<struct<place:bigint,turn_id:bigint,words:bigint>>")
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none)
    convs = materialize(convs.join(heads, "of", "left").select("conv_id", "h", taken.alias("taken")), "rebuilt")
    given = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.*")
    own = turns.join(convs.select("conv_id", "h", F.size("taken").alias("k")), "conv_id").where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "turn_id", "words")
    return given.unionByName(own), convs.select("conv_id")


def segments(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct segments (band, start, end, marks, words, n, conv_id), and conv_id, depth and key of all conversations.

    A mark stands for a turn at its place; the key of a beginning is the XOR of its marks.
    """
    marked = turns.select("conv_id", "place", F.xxhash64("place", "turn_id").alias("mark"), "words")
    each = marked.groupBy("conv_id", F.expr(f"place div {WIDTH}").alias("band")).agg(F.array_sort(F.collect_list(F.struct("place", "mark", "words"))).alias("s"), F.bit_xor("mark").alias("own"))
    each = materialize(each, "conversation-segments")
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.bit_xor("own").over(before), F.lit(0))
    parts = each.withColumn("start", start).select("conv_id", "band", "start", F.col("start").bitwiseXOR(F.col("own")).alias("end"), F.transform("s", lambda t: t["mark"]).alias("marks"), F.transform("s", lambda t: t["words"]).alias("words"))
    whole = each.groupBy("conv_id").agg(F.sum(F.size("s")).alias("depth"), F.bit_xor("own").alias("key"))
    whole = convs.join(whole, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("key", F.lit(0)).alias("key"))
    whole = materialize(whole, "conversation-ends")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    empty = whole.where("depth = 0").select("conv_id", zero.alias("band"), zero.alias("start"), zero.alias("end"), none.alias("marks"), none.alias("words"))
    rows = parts.unionByName(empty).groupBy("band", "start", "end", "marks", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return materialize(rows, "segments"), whole


def in_shards(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """The segments with the number of their shard, and of each shard the row before its first and that after its last."""
    n = max(1, -(-rows.count() // shard_rows))
    dealt = materialize(rows.repartitionByRange(n, "band", "start", "marks").withColumn("shard", F.spark_partition_id()), "shards")
    row = F.struct("band", "start", "marks")
    ends = dealt.groupBy("shard").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    order = Window.orderBy("shard")  # one row a shard
    return dealt, materialize(ends.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after")), "borders")


def common_depth(border, band: int, start: int, marks: np.ndarray) -> int:
    """How many turns a row of another shard shares with one of this; -1 without a common segment start."""
    if not border.is_valid or border["band"].as_py() != band or border["start"].as_py() != start:
        return -1
    other = np.asarray(border["marks"].values)
    m = min(len(other), len(marks))
    differ = np.flatnonzero(other[:m] != marks[:m])
    return int(differ[0]) if len(differ) else m


def shard_nodes(totals_only: bool):
    """The function of one shard: parts of its nodes, or only what lies below the starts of its segments."""

    def nodes(key: tuple, rows: pa.Table, borders: pa.Table) -> pa.Table:
        lists = rows.column("marks").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(size.max(initial=0))
        filled = np.arange(width)[None, :] < size[:, None]
        marks, words = np.full((len(size), width), PAD, dtype=np.int64), np.zeros((len(size), width + 1), dtype=np.int64)
        marks[filled] = lists.flatten().to_numpy()
        words[:, 1:][filled] = rows.column("words").combine_chunks().flatten().to_numpy()
        column = lambda c: rows.column(c).to_numpy()
        order = np.lexsort([*marks.T[::-1], column("start"), column("band")])
        marks, words, size = marks[order], words[order], size[order]
        band, start, n, conv, deeper = (column(c)[order] for c in ("band", "start", "n", "conv_id", "deeper"))
        below_leaves, below_saved = column("below_leaves")[order], column("below_saved")[order]
        last = len(size) - 1

        real = np.arange(width + 1)[None, :] <= size[:, None]
        changed = np.ones((len(size), width + 1), dtype=bool)
        changed[1:, 0] = (band[1:] != band[:-1]) | (start[1:] != start[:-1])
        changed[1:, 1:] = marks[1:] != marks[:-1]
        changed = np.logical_or.accumulate(changed, axis=1)
        new = changed.copy()
        shared = common_depth(borders.column("before")[0], band[0], start[0], marks[0, : size[0]])
        new[0, : shared + 1] = False
        behind = common_depth(borders.column("after")[0], band[last], start[last], marks[last, : size[last]])
        extends = np.zeros(len(size), dtype=bool)  # whether the next row goes on where a row ends
        extends[:-1] = ~changed[np.arange(1, last + 1), size[:-1]]
        extends[last] = behind >= size[last]
        leaves = np.where(deeper, below_leaves, ~extends).astype(np.int64)

        new &= real
        onward = lambda values: np.cumsum(values[:, ::-1], axis=1)[:, ::-1]
        saved = n[:, None] * onward(words) - onward(np.where(new, words, 0)) + below_saved[:, None]
        keys = np.concatenate([start[:, None], start[:, None] ^ np.bitwise_xor.accumulate(np.where(marks == PAD, 0, marks), axis=1)], axis=1)
        parts, above = [], None
        for k in range(1 if totals_only else width + 1):
            rows_here = np.flatnonzero(real[:, k])
            first = np.flatnonzero(changed[rows_here, k])
            if not len(first):
                break
            at, sums = rows_here[first], lambda v: np.add.reduceat(v[rows_here], first)  # noqa: E731, B023
            to = rows_here[np.r_[first[1:], len(rows_here)] - 1]
            inner = (k == 0) & (band[at] > 0)  # the node was counted as the end of a segment
            own_conv = np.minimum.reduceat(conv[rows_here], first)
            edge = inner | (k == WIDTH) | ((at == 0) & (k <= shared)) | ((to == last) & (k <= behind))
            made = {
                "depth": band[at] * WIDTH + k, "key": keys[at, k], "conv_id": pa.array(own_conv, mask=inner), "n_convs": np.where(inner, 0, sums(n)),
                "n_children": sums(new[:, k + 1].astype(np.int64)) if k < width else np.zeros(len(at), dtype=np.int64), "edge": edge,
                "n_leaves": np.where(inner & (not totals_only), 0, sums(leaves)), "saved_tokens": np.where(inner & (not totals_only), 0, sums(saved[:, k])),
            }
            if k:
                made["parent_key"] = pa.array(keys[at, k - 1])
                made["open"], parent = above[0][at], above[1][at]
                made["parent_conv_id"] = pa.array(parent, mask=made["open"])
            else:
                made |= {"parent_key": pa.nulls(len(at), pa.int64()), "parent_conv_id": pa.nulls(len(at), pa.int64()), "open": np.zeros(len(at), dtype=bool)}
            parts.append(pa.table({c.split()[0]: made[c.split()[0]] for c in NODE.split(", ")}))
            group = np.cumsum(changed[rows_here, k]) - 1
            above = np.zeros(len(size), dtype=bool), np.zeros(len(size), dtype=np.int64)
            above[0][rows_here], above[1][rows_here] = edge[group], own_conv[group]
        return pa.concat_tables(parts)

    return nodes


def totals_below(dealt: DataFrame, borders: DataFrame, rows: DataFrame) -> DataFrame:
    """band, start, below_leaves and below_saved: what lies below each key that a segment of a band above 0 starts from."""
    own = run_shards(dealt.where("band > 0"), borders, True).groupBy(F.expr(f"depth div {WIDTH}").alias("band"), F.col("key").alias("start"))
    own = own.agg(F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
    up = rows.where(F.size("marks") == WIDTH).select((F.col("band") + 1).alias("band"), F.col("end").alias("start"), F.when(F.col("band") > 0, F.struct("band", "start")).alias("up"))
    here = materialize(own.join(up, ["band", "start"]), "below")
    while here.where("up is not null").limit(1).count():
        given = here.where("up is not null").groupBy("up").agg(F.sum("below_leaves").alias("l"), F.sum("below_saved").alias("s")).select("up.*", "l", "s")
        next_ = here.select(F.struct("band", "start").alias("up"), F.col("up").alias("next"))
        moved = here.join(next_, "up", "left").join(given, ["band", "start"], "left")
        after = materialize(moved.select("band", "start", (F.col("below_leaves") + F.coalesce("l", F.lit(0))).alias("below_leaves"), (F.col("below_saved") + F.coalesce("s", F.lit(0))).alias("below_saved"), F.col("next").alias("up")), "below")
        discard(here)
        here = after
    return here.drop("up")


def run_shards(dealt: DataFrame, borders: DataFrame, totals_only: bool) -> DataFrame:
    return dealt.groupBy("shard").cogroup(borders.join(dealt.select("shard").distinct(), "shard", "left_semi").groupBy("shard")).applyInArrow(shard_nodes(totals_only), NODE)


def ends_of(whole: DataFrame) -> DataFrame:
    """depth, key and ends_sha256: the ids of the conversations that end at a node, hashed as they come in order."""

    def run(batches):
        at, digest = None, None
        for batch in batches:
            depth, key, conv = (batch.column(k).to_numpy() for k in range(3))
            first = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (key[1:] != key[:-1])]) if len(conv) else []
            done = []
            for low, high in zip(first, [*first[1:], len(conv)]):
                node = (int(depth[low]), int(key[low]))
                text = ",".join(map(str, conv[low:high].tolist())).encode()
                if node == at:
                    digest.update(b"," + text)
                    continue
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(text)
            yield made(done)
        yield made([] if at is None else [(*at, digest.hexdigest())])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "key", "ends_sha256"])

    dealt = whole.select("depth", "key", "conv_id").repartition("depth", "key").sortWithinPartitions("depth", "key", "conv_id")
    return dealt.mapInArrow(run, "depth long, key long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    turns: conv_id, place (gapless from 0), turn_id, words; convs: conv_id of all conversations, those without turns too.
    """
    rows, whole = segments(turns, convs)
    none = {"deeper": F.lit(False), "below_leaves": F.lit(0).cast("long"), "below_saved": F.lit(0).cast("long")}
    if rows.where("band > 0").limit(1).count():
        starts = rows.where("band > 0").select((F.col("band") - 1).alias("band"), F.col("start").alias("end")).distinct().withColumn("deeper", F.lit(True))
        full = rows.join(starts, ["band", "end"], "left").withColumn("deeper", F.coalesce("deeper", F.lit(False)))
        dealt, borders = in_shards(full, shard_rows)
        below = totals_below(dealt.withColumns({k: v for k, v in none.items() if k != "deeper"}), borders, rows)
        below = below.select((F.col("band") - 1).alias("band"), F.col("start").alias("end"), "below_leaves", "below_saved")
        dealt = dealt.join(below, ["band", "end"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("below_leaves", "below_saved")})
    else:
        dealt, borders = in_shards(rows, shard_rows)
        dealt = dealt.withColumns(none)
    parts = materialize(run_shards(dealt, borders, False), "trie-parts")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edges = parts.where("edge").groupBy("depth", "key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *sums, F.max("parent_conv_id").alias("parent_conv_id"), F.max("open").alias("open"))
    edges = materialize(edges, "trie-edges")
    nodes = edges.unionByName(parts.where("not edge").drop("edge"))
    parents = edges.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    found = nodes.where("open").join(parents, ["depth", "parent_key"], "left").withColumn("parent_conv_id", F.col("of_parent")).drop("of_parent")
    nodes = nodes.where("not open").unionByName(found).join(ends_of(whole), ["depth", "key"], "left")
    counts = [F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.select("conv_id", "depth", "parent_conv_id", *counts, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
