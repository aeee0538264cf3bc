"""What the operators of this subpackage share: bounded samples, held-out rows, Arrow mapping, words of whole texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..shared import discard, materialize, new_shared_path  # noqa: F401 - for the operators

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
_SPACE = re.compile(f"[{SPACES}]")
#: Characters of a long text that are handled at once; bytes of texts that come to a helper at once.
PIECE, AT_ONCE = 1 << 20, 1 << 22
#: Random values of bytes, and the factor from one place to the next, of `spelling_hashes`.
BYTE_VALUES = np.random.default_rng(5).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Groups of a sample up to which their sizes are broadcast.
MOST_GROUPS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column | str, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo parts; 0 for a null id, so that such rows are never learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def bounded_sample(df: DataFrame, key: str, limit: int, seed: int = 0, within: str | None = None) -> DataFrame:
    """At most `limit` rows (for each value of `within`, if given), one of each key: those whose keys hash lowest.

    The bound holds whatever the keys are: repeated rows, a key that many rows share and null are one key. Of rows with
    one key the least stays. The rows are the same at each run. About twice the limit is sorted, however large df is.
    """
    h, row, place = "_hash", "_row", "_place"
    part = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    columns = F.struct(*[F.col(c) for c in df.columns]).alias(row)
    hashed = df.select(F.lit(0).alias("_group") if within is None else F.col(within).alias("_group"), F.xxhash64(F.lit(seed), key).alias(h), columns)
    if within is None:
        n = hashed.agg(F.approx_count_distinct(h)).first()[0]
        low = hashed.where(part < 1.6 * limit / max(n, 1))
        return low.groupBy(h).agg(F.min(row).alias(row)).orderBy(h).limit(limit).select(f"{row}.*")
    sizes = materialize(hashed.groupBy("_group").agg((1.6 * limit / F.approx_count_distinct(h)).alias("_share")).withColumnRenamed("_group", "_own"), "sample-sizes")
    few = F.broadcast(sizes) if sizes.count() <= MOST_GROUPS else sizes
    low = hashed.join(few, F.col("_group").eqNullSafe(F.col("_own"))).where(part < F.col("_share"))
    one = low.groupBy("_group", h).agg(F.min(row).alias(row))
    ranked = one.withColumn(place, F.row_number().over(Window.partitionBy("_group").orderBy(h)))
    return ranked.where(F.col(place) <= limit).select(f"{row}.*")


def slices(column: pa.Array, rows_at_once: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of at most so many rows, and of AT_ONCE bytes unless one row is larger."""
    size = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.zeros(len(column))
    ends, at = np.cumsum(size), 0
    while at < len(column):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right"))
        to = max(at + 1, min(to, at + rows_at_once))
        yield at, to - at
        at = to


def map_texts(
    df: DataFrame,
    text_col: str,
    new_fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list], list[list]]],
    rows_at_once: int = 512,
    arrow: bool = False,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns that a vectorised helper computes from one column.

    `make` runs once in a Python worker and gives a function from a list of values (arrow: an Arrow array) to one list
    per new field. Columns of df that have the name of a new field are replaced; `keep` names those that are returned
    (all, if it is None). Batches are cut to `rows_at_once` rows and AT_ONCE bytes, so that a worker holds few texts at
    a time.
    """
    new_names = {f.name for f in new_fields}
    kept = [f for f in df.schema.fields if f.name not in new_names and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *new_fields])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_types = [to_arrow_type(f.dataType) for f in new_fields]
    names = [f.name for f in schema.fields]
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        helper = make()
        for batch in batches:
            for at, n in slices(batch.column(batch.schema.get_field_index(text_col)), rows_at_once):
                part = batch.slice(at, n)
                values = part.column(part.schema.get_field_index(text_col))
                made = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(helper(values if arrow else values.to_pylist()), arrow_types)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in kept_names] + made, names=names)

    return df.mapInArrow(run, schema)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters that end before white space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def piece_blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Numbers of the texts, and the texts or pieces of them, some PIECE characters at a time; null counts as empty."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    texts = pc.fill_null(texts, "")
    at = 0
    while at < len(texts):
        if lengths[at] > PIECE:
            for piece in pieces(texts[at].as_py()):
                yield np.array([at]), pa.array([piece])
            at += 1
            continue
        to = at + 1
        while to < len(texts) and lengths[at : to + 1].sum() <= PIECE:
            to += 1
        yield np.arange(at, to), texts.slice(at, to - at)
        at = to


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each word, number of the text that holds it, and the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    number, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    blank = pc.index(words, "").as_py()  # ends of texts with white space there
    if blank >= 0:
        real = number != blank
        number, owner = number[real], owner[real]
    return number, owner, words


def spelling_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text: a sum over its bytes, each drawn at random and weighted by its place, then mixed."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1, offset=4 * words.offset)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    begin = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(begin, size)
    weights = np.cumprod(np.full(int(size.max()) + 1, BYTE_STEP, dtype=np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * weights[place], dtype=np.uint64)])
    h = total[begin + size] - total[begin] + size.astype(np.uint64)
    for turn in (np.uint64(32), np.uint64(29)):
        h = (h ^ (h >> turn)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (lower: with A-Z in lower case) of all texts, and where each text's words begin; the end is added."""
    hashes, owners = [], []
    for number, part in piece_blocks(texts):
        of, owner, words = numbered_words(pc.ascii_lower(part) if lower else part)
        hashes.append(spelling_hashes(words)[of])
        owners.append(number[owner])
    joined, owner = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    return joined, np.searchsorted(owner, np.arange(len(texts) + 1))
