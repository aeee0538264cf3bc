"""Ranked lexical search by pipelined term partitioning: bundles of items travel from one group of term owners to the next.

Terms are dealt to stages by the share of documents that hold them, rare ones first. A bundle is some items with the
weights of their terms; it is split by blocks of documents, so that a term of any frequency meets in small groups. At
each stage a cogroup brings a bundle's block together with the postings that the stage owns there; it adds their integer
contributions to the bundle's sparse accumulators (document, item, score) and hands them on to the next stage. The best
scores of the last stage's accumulators are the answer.

Between stages an accumulator is dropped when it can't reach its item's answer any more: when its score and the most that
the stages to come can add stay below the score that already `top` documents of the item have. That changes no answer.

Only terms of the items leave the tasks that cut the documents, if the items have at most `MAX_SENT` terms; beyond that
all terms are shuffled. Both give the same rows. Counts of documents and terms are over all documents.

Defined results: a null or empty text has no terms and is found by nothing; an item without terms has no answer; each
row of the items is an item of its own, and each row of the documents a document, also where ids repeat; of equal scores
the smaller id comes first and a null id last; fewer documents than asked for are all given; empty tables give an empty
table; columns other than id and text are ignored. A very long text is cut in pieces and leaves its counts only. Equal
terms are told by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import discard, map_texts, materialize, new_shared_path, numbered_words, piece_blocks, spelling_hashes

TOP = 20
#: Items of a bundle, and documents of a block, on average.
BUNDLE, BLOCK = 128, 4096
#: Terms of all items up to which they are sent to all tasks, and items up to which their limits are.
MAX_SENT, MAX_ITEMS = 500_000, 200_000
#: Shares of the documents up to which a term belongs to a stage.
STAGES = (0.001, 0.01, 0.1, 1.0)
#: What becomes of a byte: A-Z are lower-cased, and ASCII that is no letter or digit separates terms.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)
NO_NUMBERS = np.zeros(0, dtype=np.int64)


def spaced(texts: pa.Array) -> pa.Array:
    """The texts in lower case, with a space in place of each separator."""
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(BYTES[raw]))


def term_counts(texts: pa.Array, wanted: np.ndarray | None = None) -> list:
    """Number of terms, different terms (hashes; of `wanted`, sorted, if given) and how often each occurs, of each text."""
    size, owners, terms, counts = np.zeros(len(texts), dtype=np.int64), [NO_NUMBERS], [NO_NUMBERS], [NO_NUMBERS]
    for number, part in piece_blocks(texts):
        of, owner, words = numbered_words(spaced(part))
        size += np.bincount(number[owner], minlength=len(texts))
        hashes = spelling_hashes(words).view(np.int64)
        if wanted is not None:
            known = np.zeros(len(hashes), dtype=bool)
            if len(wanted):
                known = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes
            of, owner = of[known[of]], owner[known[of]]
        pair, n = np.unique(owner * max(len(words), 1) + of, return_counts=True)
        owners.append(number[pair // max(len(words), 1)])
        terms.append(hashes[pair % max(len(words), 1)])
        counts.append(n)
    owner, term, count = np.concatenate(owners), np.concatenate(terms), np.concatenate(counts)
    order = np.lexsort((term, owner))
    owner, term, count = owner[order], term[order], count[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])]) if len(owner) else NO_NUMBERS
    begin = pa.array(np.searchsorted(owner[first], np.arange(len(texts) + 1)).astype(np.int32))
    total = np.add.reduceat(count, first) if len(first) else NO_NUMBERS
    return [pa.array(size), pa.ListArray.from_arrays(begin, pa.array(term[first])), pa.ListArray.from_arrays(begin, pa.array(total))]


def counted_texts(df: DataFrame, id_col: str, text_col: str, make) -> DataFrame:
    """id, row (a number of its own), n (terms), terms and counts of each row; written, so that the numbers stay."""
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("n", T.LongType()), T.StructField("terms", longs), T.StructField("counts", longs)]
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(map_texts(texts, "text", fields, make, arrow=True).drop("text").withColumn("row", F.monotonically_increasing_id()), "counted-texts")


def postings_of(counted: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf")))
    return counted.select("row", "n", each.alias("_p")).select("row", "n", "_p.term", "_p.tf")


def visitor(stage: int, top: int, is_last: bool):
    """The function of a stage for one bundle and block: adds the contributions of the stage's postings."""

    def visit(key: tuple, bundle: pa.Table, postings: pa.Table) -> pa.Table:
        row = {c: bundle.column(c)[0] for c in bundle.column_names}
        entries = row["entries"].values
        of = {c: np.asarray(entries.field(c)) for c in ("stage", "term", "item", "weight", "bound")}
        old = {c: np.asarray(row[c].values) for c in ("rows", "items", "scores")}
        items = np.unique(np.concatenate([of["item"], old["items"]]))  # an item's last term may be behind it
        place = np.searchsorted(items, of["item"])
        new = {c: postings.column(c).to_numpy() for c in ("row", "term", "part")}
        rows = np.unique(np.concatenate([old["rows"], new["row"]]))
        scores = np.zeros((len(rows), len(items)), dtype=np.int64)
        scores[np.searchsorted(rows, old["rows"]), np.searchsorted(items, old["items"])] = old["scores"]

        order = np.argsort(new["term"], kind="stable")
        term, at, part = new["term"][order], np.searchsorted(rows, new["row"][order]), new["part"][order]
        own = np.flatnonzero(of["stage"] == stage)
        own = own[np.argsort(of["term"][own], kind="stable")]
        own_terms, first = np.unique(of["term"][own], return_index=True)
        low, high = np.searchsorted(term, own_terms), np.searchsorted(term, own_terms, side="right")
        for i in np.flatnonzero(high > low):
            asked = own[first[i] : first[i + 1] if i + 1 < len(first) else len(own)]
            here = slice(low[i], high[i])
            scores[np.ix_(at[here], place[asked])] += part[here][:, None] * of["weight"][asked][None, :]

        rest = np.zeros(len(items), dtype=np.int64)
        later = of["stage"] > stage
        np.add.at(rest, place[later], of["bound"][later])
        least = np.zeros(len(items), dtype=np.int64)
        if row["limits"].is_valid and len(row["limits"].values):
            limits = row["limits"].values
            at = np.searchsorted(items, np.asarray(limits.field("item")))
            least[at] = np.asarray(limits.field("least"))
        best = -np.partition(-scores, top - 1, axis=0)[:top] if len(rows) > top else scores
        if is_last and len(rows) > top:
            least = np.maximum(least, best.min(axis=0))  # equal scores all stay
        kept = (scores > 0) & (scores + rest >= least)
        doc, item = np.nonzero(kept)
        best_row, best_item = np.nonzero((best > 0) & (best >= least))
        one = lambda values, kind=pa.int64(): pa.array([values], pa.list_(kind))
        left = entries.filter(pa.array(later))
        columns = [
            pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), left),
            one(rows[doc]), one(items[item]), one(scores[doc, item]), one(items[best_item]), one(best[best_row, best_item]),
        ]
        return pa.Table.from_arrays(columns, names=["bundle", "block", "entries", "rows", "items", "scores", "best_items", "best_scores"])

    return visit


ENTRIES = "array<struct<stage:int,term:bigint,item:bigint,weight:bigint,bound:bigint>>"
CARRIED = f"bundle long, block long, entries {ENTRIES}, rows array<long>, items array<long>, scores array<long>, best_items array<long>, best_scores array<long>"


def search(df: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_sent: int = MAX_SENT, bundle_items: int = BUNDLE, block_rows: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` documents of each item; bundle_items and block_rows bound the groups."""
    spark = df.sparkSession
    asked = counted_texts(items, item_col, item_text_col, lambda: term_counts)
    wanted = materialize(postings_of(asked).select("term").distinct(), "item-terms")
    n_items, n_terms = asked.count(), wanted.count()
    few = n_terms <= max_sent
    if few:
        sent = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()))
        docs = counted_texts(df, id_col, text_col, lambda: lambda texts: term_counts(texts, sent.value))
    else:
        docs = counted_texts(df, id_col, text_col, lambda: term_counts)
    n_docs, n_words = docs.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    n_words = max(n_words or 0, 1)

    postings = postings_of(docs)
    if not few:
        postings = postings.join(wanted, "term", "left_semi")
    weighed = postings.withColumn("part", F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * (75 + (25 * n * {n_docs}L) div {n_words}L))"))
    owned = weighed.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    stage = F.lit(len(STAGES) - 1)
    for k in range(len(STAGES) - 2, -1, -1):
        stage = F.when(F.col("df") <= STAGES[k] * n_docs, k).otherwise(stage)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    owned = materialize(owned.select("term", weight.cast("long").alias("weight"), "most", stage.alias("stage")), "term-owners")

    n_bundles, n_blocks = -(-n_items // bundle_items), max(-(-n_docs // block_rows), 1)
    entries = postings_of(asked).join(owned, "term").where("weight > 0").withColumn("bundle", F.pmod(F.xxhash64("row"), F.lit(max(n_bundles, 1))))
    entry = F.struct("stage", "term", F.col("row").alias("item"), (F.col("weight") * F.col("tf")).alias("weight"), (F.col("weight") * F.col("tf") * F.col("most")).alias("bound"))
    entries = materialize(entries.select("bundle", entry.alias("e")), "bundle-entries")
    visits = entries.select("bundle", "e.term", "e.stage").distinct()
    dealt = weighed.join(F.broadcast(visits) if entries.count() <= max_sent else visits, "term")
    path = new_shared_path(spark, "postings")
    dealt.select("stage", "bundle", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"), "row", "term", "part").write.partitionBy("stage").parquet(path)
    owned_postings = spark.read.schema("bundle long, block long, row long, term long, part long, stage int").parquet(path)

    none = F.array().cast("array<long>")
    bundles = entries.groupBy("bundle").agg(F.collect_list("e").alias("entries"))
    carried = bundles.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1).cast("long"))).alias("block"), "entries", none.alias("rows"), none.alias("items"), none.alias("scores"), F.lit(None).cast("array<struct<item:bigint,least:bigint>>").alias("limits"))
    keys = ["bundle", "block"]
    last, done = len(STAGES) - 1, []
    for k in range(len(STAGES)):
        here = owned_postings.where(F.col("stage") == k).drop("stage")
        after = carried.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(visitor(k, top, k == last), CARRIED)
        after = materialize(after, "bundles")
        discard(*done)
        done = [after]
        if k < last:
            limits = item_limits(after, top)
            limits = F.broadcast(limits) if n_items <= MAX_ITEMS else limits
            carried = after.drop("best_items", "best_scores").join(limits, "bundle", "left")
    scored = after.select(F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("items").alias("item"), F.col("scores").alias("score"))).alias("_s")).select("_s.*")
    ordered = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    ranked = scored.join(docs.select("row", F.col("id").alias("doc_id")), "row").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    return ranked.join(asked.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item").select("item_id", "rank", "doc_id", "score")


def item_limits(carried: DataFrame, top: int) -> DataFrame:
    """bundle and limits: the score that `top` documents of an item have already, for items with that many."""
    best = carried.select("bundle", F.explode(F.arrays_zip(F.col("best_items").alias("item"), F.col("best_scores").alias("score"))).alias("_b")).select("bundle", "_b.*")
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy("bundle", "item").orderBy(F.col("score").desc()))).where(F.col("_r") <= top)
    least = ranked.where(F.col("_r") == top).select("bundle", F.struct("item", F.col("score").alias("least")).alias("l"))
    return least.groupBy("bundle").agg(F.collect_list("l").alias("limits"))
