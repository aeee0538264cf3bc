"""Byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across, so a cut between the two bytes is
certain. Each pre-token is cut at all such pairs, the fragments are merged independently of each other, and their ids
are concatenated. Texts come as chunks, runs of pre-tokens between which white space forces a boundary. Chunks repeat, so
each worker remembers the ids of those it has met; the fragments of all new chunks of a block of texts are merged at once,
as columns of a matrix.

Defined results: a null text counts as the empty text (no ids, decoded to ""); the strings of added tokens in a text
become their single ids, as the tokenizers library does; repeated rows are encoded each; columns of the input that are
named like an output column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, types as T

from .common import PIECE, map_texts

#: The pre-tokenizer's pattern; a fixed value of the byte-level format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space and what follows it; pre-tokens end where these do. Where a space is next to no other white space, it begins one.
CHUNK = r"\s*+\S++|\s++"
SPACE_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")
#: Chunks that a worker remembers before it starts anew, some 100 MB; characters of the longest that it remembers.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
#: Fragments of more bytes are merged one by one by a heap, others in matrices of up to so many rows.
SHORT = 48
ROWS = (2, 3, 4, 6, 8, 12, 16, 24, 32, SHORT)
#: A rank and a row are one number; this one stands for pairs that can't be joined.
ROW_BITS, NO_JOIN = 6, np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes are themselves, others follow U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """The tokenizer of one vocabulary file, for use inside tasks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.id_of_byte = [0] * 256
        for i, token in self.bytes_of.items():
            if len(token) == 1:
                self.id_of_byte[token[0]] = i
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}  # rank, and id of what is joined
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.joins[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.pairs = _Pairs(self.joins, max(vocab.values()) + 1)
        self.joined = np.zeros(len(spec["model"]["merges"]), dtype=np.int32)  # by rank
        for rank, new in self.joins.values():
            self.joined[rank] = new
        inside = np.zeros((256, 256), dtype=bool)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:]):
                inside[a, b] = True
        self.cut = ~inside.reshape(-1)  # by first byte * 256 + second
        self.id_of_byte = np.array(self.id_of_byte, dtype=np.int32)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.find, self.find_chunks = regex.compile(PRE_TOKEN).findall, regex.compile(CHUNK).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.remembered: dict[str, bytes] = {}

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        joins, after, before = self.joins, [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(j[0], i, j[1], ids[i], ids[i + 1]) for i in range(n - 1) if (j := joins.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            right = after[i]
            if ids[i] != a or right >= n or ids[right] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[right] = new, -1
            after[i] = nxt = after[right]
            if nxt < n:
                before[nxt] = i
                if j := joins.get((new, ids[nxt])):
                    heapq.heappush(heap, (j[0], i, j[1], new, ids[nxt]))
            if (left := before[i]) >= 0 and (j := joins.get((ids[left], new))):
                heapq.heappush(heap, (j[0], left, j[1], ids[left], new))
        return [i for i in ids if i >= 0]

    def _merge_columns(self, ids: np.ndarray) -> None:
        """Merge the fragments that are the columns of ids in place; what is below them is pad, joined tokens become -1.

        Each turn joins the pair of least rank, leftmost first, of every column. The last row is pad throughout.
        """
        last, n = ids.shape[0] - 1, ids.shape[1]
        rows = np.arange(last + 1, dtype=np.int32)[:, None]
        after, before = np.repeat(np.minimum(rows + 1, last), n), np.repeat(np.where(rows, rows - 1, last), n)
        key = np.full((last + 1, n), NO_JOIN, dtype=np.int32)
        for row in range(last):
            key[row] = self.pairs.keys(ids[row], ids[row + 1], row)
        flat, keys = ids.reshape(-1), key.reshape(-1)
        while True:
            least = key.min(axis=0)
            column = np.flatnonzero(least != NO_JOIN)
            if not len(column):
                return
            least = least[column]
            row = least & ((1 << ROW_BITS) - 1)
            here, new = row * n + column, self.joined[least >> ROW_BITS]
            gone = after[here] * n + column
            right, left = after[gone], before[here]
            at_right, at_left = right * n + column, left * n + column
            flat[here], flat[gone], keys[gone] = new, -1, NO_JOIN
            after[here], before[at_right] = right, row
            keys[here] = self.pairs.keys(new, flat[at_right], row)
            keys[at_left] = self.pairs.keys(flat[at_left], new, left)

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the fragments of data (bytes) that begin at `starts`, and where each fragment's ids begin; the end is added."""
        sizes = np.diff(starts, append=len(data))
        count = np.ones(len(starts), dtype=np.int64)
        parts = []  # fragments, and their ids in a row
        one = np.flatnonzero(sizes == 1)
        parts.append((one, self.id_of_byte[data[starts[one]]]))
        low = 1
        for high in ROWS:
            these = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if len(these):
                ids = np.full((high + 1, len(these)), self.pairs.pad, dtype=np.int32)
                for row in range(high):
                    has = np.flatnonzero(sizes[these] > row) if row else slice(None)
                    ids[row, has] = self.id_of_byte[data[starts[these][has] + row]]
                self._merge_columns(ids)
                columns = ids[:-1].T
                stays = (columns >= 0) & (columns != self.pairs.pad)
                count[these] = stays.sum(axis=1)
                parts.append((these, columns[stays]))
        made: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(sizes > SHORT).tolist():
            fragment = data[starts[i] : starts[i] + sizes[i]]
            if (ids := made.get(spelt := fragment.tobytes())) is None:
                ids = made[spelt] = self._merge_long(self.id_of_byte[fragment].tolist())
            count[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, dtype=np.int32)))
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], dtype="<u4")
        for these, ids in parts:
            n = count[these]
            out[np.repeat(begin[these] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, begin

    def encode_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of each chunk: cut where no vocabulary token can reach across, and the fragments merged."""
        alone = [c for c in chunks if c[:1] != " " or c[-1].isspace()]
        beside = "".join(others := list(chunks.difference(alone)))  # the pre-tokens of these are the same side by side
        words = chain(self.find(beside), chain.from_iterable(map(self.find, alone)))
        chunks = others + alone
        data = np.frombuffer((beside + "".join(alone)).encode(), dtype=np.uint8)
        letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the byte where each character begins
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[letters[np.cumsum(np.fromiter(map(len, words), dtype=np.int64))]] = True
        begins[1:-1] |= self.cut[data[:-1].astype(np.int32) << 8 | data[1:]]
        begins[0], begins[-1] = len(data) > 0, False
        starts = np.flatnonzero(begins)
        ids, begin = self.merge(data, starts)
        ends = letters[np.cumsum(np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)))]
        ends, raw = (4 * begin[np.searchsorted(starts, ends)]).tolist(), ids.tobytes()
        return {c: raw[a:b] for c, a, b in zip(chunks, [0, *ends], ends)}

    def chunks(self, text: str) -> list[str]:
        """The text in parts that are encoded alone: none of them ends within a pre-token, whatever comes next."""
        if "\0" in text or SPACE_BEFORE_SPACE.search(text):
            return self.find_chunks(text)
        return text.replace(" ", "\0 ").split("\0")

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        chunks = [[t] if t in self.added else self.chunks(t) for t in texts]
        if len(self.remembered) >= REMEMBERED:
            self.remembered = {}
        ids_of = self.remembered
        ids_of.update((s, i.to_bytes(4, "little")) for s, i in self.added.items())
        new = set(chain.from_iterable(chunks)).difference(ids_of)
        ids_of.update(self.encode_chunks(new))
        ids = [b"".join(map(ids_of.__getitem__, c)) for c in chunks]
        for c in [c for c in new if len(c) > REMEMBERED_LENGTH]:
            del ids_of[c]
        return ids

    def _pieces(self, text: str) -> Iterator[str]:
        """Added tokens of a text, and what is between them, cut before spaces if it is long."""
        parts = self.split_added.split(text) if any(s in text for s in self.added) else [text]
        for part in parts:
            at = 0
            while len(part) - at > PIECE:
                to = part.find(" ", at + PIECE)
                while to >= 0 and part[to - 1].isspace():
                    to = part.find(" ", to + 1)
                if to < 0:
                    break
                yield part[at:to]
                at = to
            yield part[at:]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; some PIECE characters are worked on at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        block, owners, size = [], [], 0
        for n, text in enumerate(texts):
            for piece in self._pieces(text):
                block.append(piece)
                owners.append(n)
                size += len(piece)
                if size >= PIECE:
                    for owner, ids in zip(owners, self._encode_block(block)):
                        out[owner].append(ids)
                    block, owners, size = [], [], 0
        for owner, ids in zip(owners, self._encode_block(block)):
            out[owner].append(ids)
        return [b"".join(o) for o in out]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


class _Pairs:
    """Ranks of pairs of ids in a hash table that is asked for many pairs at once."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, joins: dict[tuple[int, int], tuple[int, int]], pad: int) -> None:
        """pad: an id that no pair has."""
        self.pad, bits = pad, max(4, (4 * len(joins)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.zeros(1 << bits, dtype=np.int32)
        pairs = np.array([a * (pad + 1) + b for a, b in joins], dtype=np.int64)
        taken: dict[int, int] = {}
        for i, slot in enumerate(self._slots(pairs).tolist()):
            while slot in taken:
                slot = (slot + 1) & self.mask
            taken[slot] = i
        order = list(taken.values())
        self.pair[list(taken)] = pairs[order]
        self.rank[list(taken)] = np.array([rank for rank, _ in joins.values()], dtype=np.int32)[order]

    def _slots(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * self.FACTOR) >> self.shift).astype(np.int64)

    def keys(self, left: np.ndarray, right: np.ndarray, row: np.ndarray | int) -> np.ndarray:
        """Rank and row of each pair as one number, or NO_JOIN."""
        pair = left.astype(np.int64) * (self.pad + 1) + right
        slot = self._slots(pair)
        held = self.pair[slot]
        rank = np.where(held == pair, self.rank[slot], -1)
        again = np.flatnonzero((held != pair) & (held >= 0))  # another pair has the slot: the next one
        slot = slot[again]
        while len(again):
            slot = (slot + 1) & self.mask
            held = self.pair[slot]
            found = held == pair[again]
            rank[again[found]] = self.rank[slot[found]]
            open_ = ~found & (held >= 0)
            again, slot = again[open_], slot[open_]
        return np.where(rank >= 0, rank << ROW_BITS | row, NO_JOIN).astype(np.int32)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ForcedBoundaryBpe:
    """One tokenizer a worker and file; workers are reused from task to task."""
    return ForcedBoundaryBpe(path)


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """Add the token ids of a text column as binary (little-endian unsigned 32-bit integers) and their number."""

    def make():
        encode = tokenizer(tokenizer_path).encode_all

        def run(texts: list) -> list[list]:
            ids = encode([t or "" for t in texts])
            return [ids, [len(i) // 4 for i in ids]]

        return run

    return map_texts(df, text_col, [T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())], make)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the text that a column of ids (as of bpe_encode; null: none) stands for."""

    def make():
        decode = tokenizer(tokenizer_path).decode

        def run(ids: list) -> list[list]:
            return [[decode(i) if i else "" for i in ids]]

        return run

    return map_texts(df, ids_col, [T.StructField(decoded_col, T.StringType())], make)


def bpe_round_trip(
    df: DataFrame, tokenizer_path: str, keep: list[str], text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", same_col: str | None = "round_trip", decoded_col: str | None = None
) -> DataFrame:
    """The columns `keep` with the token ids of a text column, their number, whether they decode to the text again
    (same_col; None: not told), and what they decode to (decoded_col; None: not told).

    Both ways are one pass, so that a task has one worker and one tokenizer, and texts are not sent back unless asked for.
    """

    def make():
        bpe = tokenizer(tokenizer_path)

        def run(texts: list) -> list[list]:
            ids = bpe.encode_all([t or "" for t in texts])
            out = [ids, [len(i) // 4 for i in ids]]
            decoded = [bpe.decode(i) if i else "" for i in ids]
            if same_col is not None:
                out.append([d == (t or "") for d, t in zip(decoded, texts)])
            return out if decoded_col is None else [*out, decoded]

        return run

    fields = [T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())]
    if same_col is not None:
        fields.append(T.StructField(same_col, T.BooleanType()))
    if decoded_col is not None:
        fields.append(T.StructField(decoded_col, T.StringType()))
    return map_texts(df, text_col, fields, make, keep=keep)
