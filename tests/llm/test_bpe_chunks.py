"""BPE of blocks of texts: chunks, pieces, what is remembered, and the work for words that were not met before."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe
from tallyspark.llm.queries import QUERIES, tokenizer_path

MARKS = [*"abcdeé漢🙂 \n\t\x85\xa0　'.,!#019²\0\x1c\x1f\r\x0b", "<|endoftext|>", "'ll", "    ", "hello", " the", "ation", " x", "  ", " \n"]


def library_ids():
    own = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def some_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(MARKS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzAEI") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    scripts = [(0x400, 0x4FF), (0x900, 0x97F), (0x4E00, 0x9FFF), (0xE00, 0xE7F), (0x1F300, 0x1F6FF), (32, 32), (9, 13)]
    return texts + ["".join(chr(rng.randint(*rng.choice(scripts))) for _ in range(rng.randint(0, 200))) for _ in range(100)]


@pytest.mark.parametrize("piece, remembered, length", [(1 << 20, 400_000, 64), (50, 400_000, 64), (7, 20, 3), (200, 0, 0)])
def test_blocks_equal_the_tokenizers_library(monkeypatch, piece, remembered, length):
    """At any size of pieces and blocks, and whatever is remembered or forgotten."""
    for name, value in (("PIECE", piece), ("REMEMBERED", remembered), ("REMEMBERED_LENGTH", length)):
        monkeypatch.setattr(bpe, name, value)
    ids, ours, texts = library_ids(), bpe.ForcedBoundaryBpe(tokenizer_path()), some_texts()
    made = ours.encode_all(texts)
    assert [t for t, m in zip(texts, made) if m != ids(t)] == []
    assert ours.encode_all(texts) == made and ours.encode_all([]) == []
    long = "".join(texts)
    assert ours.encode(long) == ids(long)


def test_chunks_join_to_the_text_and_end_with_pre_tokens():
    ours = bpe.ForcedBoundaryBpe(tokenizer_path())
    for text in some_texts():
        chunks = ours.chunks(text)
        assert "".join(chunks) == text
        assert [w for c in chunks for w in ours.find(c)] == ours.find(text), text


def test_unlike_words_take_no_python_call_each():
    """New words are cut and merged together: before, each was by a call of its own, and they were most of the time."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice(["th", "er", "on", "an", "ing", "é", "q", "zx", "ation"]) for _ in range(6)) for _ in range(30_000))
    ours, calls = bpe.ForcedBoundaryBpe(tokenizer_path()), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        made = ours.encode(text)
    finally:
        sys.setprofile(None)
    assert calls < 10_000, calls
    assert made == library_ids()(text)


def test_op1_is_one_pass(spark, sf_dir):
    both = QUERIES["op1_bpe"](spark, sf_dir)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan  # ids go to no second worker
    assert both.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    apart = bpe.bpe_decode(bpe.bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()), tokenizer_path())
    apart = apart.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
    assert sorted(both.collect()) == sorted(apart.collect())
