"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE_WORDS` words. Every passage becomes a vector of byte-class shares, shares of
pairs of byte classes, and word statistics; a learned layer encodes it; gated attention (a tanh and a sigmoid branch)
weighs the passages of a text against each other; the weighted sum is scored. Only the text's label is known, so the
weights of the passages are learned from it. The network is trained on a bounded sample of labelled rows of any length,
of each of which it sees at most `passages_per_doc` passages, drawn evenly over the whole text; every whole text is
scored. The passages of a very long text come in blocks of about `BLOCK` bytes whose weighted sums are added up.

Defined results: a null or empty text is one empty passage and gets the score of that; if labels of both kinds are
missing, every score is 1 (nothing is rejected); rows with a null id are never learned from; several labels of one id
count as the lowest; repeated rows are scored each; columns named like an output column are replaced; an empty table
gives an empty table. A very long text takes some 90 bytes of memory a byte of one block, not of the text; a passage is
held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_sample, crc_mod, map_texts

PASSAGE_WORDS = 64
#: A score from which a text counts as good; fixed by the contract.
THRESHOLD = 0.3
#: Bytes encoded at once in a worker.
BLOCK = 1 << 18


def byte_classes() -> np.ndarray:
    """Class of each byte: letters, digits, kinds of marks, space, line end, parts of non-ASCII characters."""
    kind = np.full(256, 11, dtype=np.int64)  # other control bytes and marks
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[32, 9, 11, 12, 13]] = 3
    kind[10] = 4
    for k, marks in enumerate((".,;:", "!?", "#*$%&", "|", "-_/@+=", "'\"()[]{}<>~`^\\"), start=5):
        kind[[ord(c) for c in marks]] = k
    kind[128:192], kind[192:256] = 12, 13
    return kind


CLASSES = 14
WIDTH = CLASSES + CLASSES * CLASSES + 5
_KIND = byte_classes()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def passage_blocks(raw: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text cut where a passage begins, into blocks of at most `size` bytes unless one passage is longer."""
    at = 0
    while len(raw) - at > size:
        take = size
        while True:
            data = np.frombuffer(raw, dtype=np.uint8, count=min(take, len(raw) - at), offset=at)
            space = _SPACE[data]
            begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
            whole = (len(begins) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
            if whole > 0 or take >= len(raw) - at:
                break
            take *= 2
        if whole <= 0:
            break
        yield raw[at : at + int(begins[whole])]
        at += int(begins[whole])
    yield raw[at:]


def passages(texts: list[bytes], closed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages, and the number of the text that each belongs to. closed: it ends with white space."""
    sizes = np.array([len(t) + (not closed) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts) if closed else b"\n".join(texts) + b"\n", dtype=np.uint8)  # the added line end closes a text's last word
    owner = np.repeat(np.arange(len(texts)), sizes)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = np.cumsum(sizes) - sizes
    nth = np.cumsum(begins)
    before = np.where(first > 0, nth[first - 1], 0)
    within = np.maximum(nth - before[owner] - 1, 0) // PASSAGE_WORDS
    change = np.ones(len(data), dtype=bool)
    change[1:] = (owner[1:] != owner[:-1]) | (within[1:] != within[:-1])
    passage = np.cumsum(change) - 1
    count = int(passage[-1]) + 1
    kind = _KIND[data]
    single = np.bincount(passage * CLASSES + kind, minlength=count * CLASSES).reshape(count, CLASSES)
    same = passage[1:] == passage[:-1]
    pair = np.bincount((passage[1:] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:])[same], minlength=count * CLASSES * CLASSES).reshape(count, CLASSES * CLASSES)
    size = np.maximum(single.sum(1, keepdims=True), 1)
    starts = np.flatnonzero(begins)
    words = np.bincount(passage[starts], minlength=count)
    distinct, again, length = np.zeros(count), np.zeros(count), np.zeros(count)
    if len(starts):
        ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        spell = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spell ^= spell >> np.uint64(29)
        spot = (np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.arange(len(data)) - np.concatenate([np.zeros(starts[0], dtype=np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))]))
        spell *= (spot.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        spell[space] = 0
        spelled = np.add.reduceat(spell, starts)
        of = passage[starts]
        order = np.lexsort((spelled, of))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (of[order][1:] != of[order][:-1]) | (spelled[order][1:] != spelled[order][:-1])
        distinct = np.bincount(of[order][new], minlength=count)
        repeat = np.zeros(len(starts), dtype=bool)
        repeat[1:] = (spelled[1:] == spelled[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[repeat], minlength=count)
        length = np.bincount(of, weights=ends - starts, minlength=count)
    w = np.maximum(words, 1)
    vectors = np.concatenate([np.sqrt(single / size), np.sqrt(pair / size), np.column_stack([distinct / w, again / w, length / w / 10, np.log1p(words) / 4, (words == 0)])], axis=1)
    return vectors.astype(np.float32), owner[np.flatnonzero(change)]


class AttentionNet:
    """z = relu(xW); a = softmax over a text's passages of w . (tanh(zV) * sigmoid(zU)); score = sigmoid(c . sum(a z))."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        shapes = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
        self.p = {k: (rng.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s) if k in "bd" else rng.normal(size=s) / np.sqrt(s[0])) for k, s in shapes.items()}
        self.mean, self.spread = np.zeros(WIDTH), np.ones(WIDTH)

    def _forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple:
        p = self.p
        z = np.maximum(x @ p["W"] + p["b"], 0)
        t, s = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        m = np.add.reduceat(a[:, None] * z, starts, axis=0)
        return z, t, s, a, m, 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))

    def score(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Score of each text; owner is sorted, and each text has a passage."""
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        return self._forward((x - self.mean) / self.spread, starts, owner)[-1]

    def score_blocks(self, blocks: Iterator[np.ndarray]) -> float:
        """Score of one text whose passages come in blocks."""
        p, top, total, m = self.p, -np.inf, 0.0, np.zeros(len(self.p["c"]))
        for x in blocks:
            z = np.maximum((x - self.mean) / self.spread @ p["W"] + p["b"], 0)
            e = (np.tanh(z @ p["V"]) / (1 + np.exp(-(z @ p["U"])))) @ p["w"]
            new = max(top, e.max())
            e, kept = np.exp(e - new), np.exp(top - new)
            total, m, top = total * kept + e.sum(), m * kept + e @ z, new
        return float(1 / (1 + np.exp(-np.clip(m / total @ p["c"] + p["d"][0], -30, 30))))

    def train(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = 240, rate: float = 0.01, decay: float = 1e-4) -> None:
        """Adam over all texts at once on the log loss; the gradients of the formulas above, by hand."""
        self.mean, self.spread = x.mean(0), x.std(0) + 0.02
        x = ((x - self.mean) / self.spread).astype(np.float32)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            p = self.p
            z, t, s, a, m, out = self._forward(x, starts, owner)
            g_out = (out - y) / len(y)
            g_m = g_out[:, None] * p["c"]
            per = g_m[owner]
            g_a = (per * z).sum(1)
            g_e = a * (g_a - np.add.reduceat(a * g_a, starts)[owner])
            g_t, g_s = g_e[:, None] * p["w"] * s * (1 - t * t), g_e[:, None] * p["w"] * t * s * (1 - s)
            g_z = (a[:, None] * per + g_t @ p["V"].T + g_s @ p["U"].T) * (z > 0)
            grads = {"W": x.T @ g_z, "b": g_z.sum(0), "V": z.T @ g_t, "U": z.T @ g_s, "w": (t * s).T @ g_e, "c": m.T @ g_out, "d": np.array([g_out.sum()])}
            for k, g in grads.items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def block_vectors(raw: bytes) -> Iterator[np.ndarray]:
    """Vectors of a text's passages, block by block."""
    left = len(raw)
    for block in passage_blocks(raw):
        left -= len(block)
        yield passages([block], closed=left > 0)[0]


def drawn_vectors(raw: bytes, most: int) -> np.ndarray:
    """Vectors of at most `most` passages of a text, from its begin to its end."""
    kept = np.concatenate([x for x in block_vectors(raw)])
    return kept if len(kept) <= most else kept[np.linspace(0, len(kept) - 1, most).astype(int)]


def score_texts(net: AttentionNet | None, texts: list[str | None]) -> list[float]:
    out: list[float] = []
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < BLOCK):
            part.append((texts[at] or "").encode())
            size += len(part[-1])
            at += 1
        if net and size > 2 * BLOCK:
            out += [net.score_blocks(block_vectors(raw)) for raw in part]
            continue
        out += net.score(*passages(part)).tolist() if net else [1.0] * len(part)
    return out


def train_quality(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 3000, passages_per_doc: int = 64) -> AttentionNet | None:
    """Train on at most `sample_docs` labelled ids, one text each, and `passages_per_doc` passages; both bound what reaches the driver."""
    marked = labels.groupBy(id_col).agg(F.min("quality").alias("quality")).where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull())
    chosen = bounded_sample(marked.where(crc_mod(id_col) != 0), id_col, sample_docs, seed=20)
    rows = df.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), id_col)

    def make():
        def run(texts: list) -> list[list]:
            return [[drawn_vectors((t or "").encode(), passages_per_doc).tobytes() for t in texts]]

        return run

    got = map_texts(rows.select(id_col, "quality", text_col), text_col, [T.StructField("passages", T.BinaryType())], make).select(id_col, "quality", "passages")
    got = got.groupBy(id_col).agg(F.min("quality").alias("quality"), F.min("passages").alias("passages")).toPandas()  # of texts with one id the least
    if got["quality"].nunique() < 2:
        return None
    got = got.sort_values(id_col).reset_index(drop=True)
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for b in got["passages"]]
    net = AttentionNet()
    net.train(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), got["quality"].to_numpy(dtype=np.float64))
    return net


def score_quality(df: DataFrame, net: AttentionNet | None, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Add the score and the decision to every row."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def make():
        return lambda texts: [score_texts(shared.value, texts)]

    return map_texts(df, text_col, [T.StructField(score_col, T.DoubleType())], make).withColumn(predicted_col, (F.col(score_col) >= THRESHOLD).cast("int"))


def classify_quality(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, and score all: id, held_out, score, predicted."""
    net = train_quality(df, labels, text_col, id_col)
    marked = df.select(id_col, (crc_mod(id_col) == 0).alias("held_out"), text_col)
    return score_quality(marked, net, text_col).drop(text_col)
