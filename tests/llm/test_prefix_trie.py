"""The prefix trie against brute force: random tries in shards of few rows, long conversations, copies, and odd tables."""

import hashlib
import random
import re
import zlib

import pytest

from tallyspark.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt_turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """Turns of each conversation, in order."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    """Nodes by their paths, from the root on; a path is told by the number of its node."""
    child, n, low, ends, words, up = {}, {}, {}, {}, {0: 0}, {0: None}
    depth = {0: 0}
    for c in sorted(convs):
        at = 0
        for d in range(len(convs[c]) + 1):
            if d:
                key = (at, convs[c][d - 1])
                if key not in child:
                    child[key] = len(depth)
                    up[child[key]], depth[child[key]], words[child[key]] = at, d, len(WORD.findall(convs[c][d - 1][1]))
                at = child[key]
            n[at] = n.get(at, 0) + 1
            low.setdefault(at, c)
        ends.setdefault(at, []).append(c)
    kids, leaves, saved = dict.fromkeys(n, 0), dict.fromkeys(n, 0), {v: (n[v] - 1) * words[v] for v in n}
    for v in sorted(n, reverse=True):  # children have larger numbers
        leaves[v] = leaves[v] or 1
        if up[v] is not None:
            kids[up[v]] += 1
            leaves[up[v]] += leaves[v]
            saved[up[v]] += saved[v]
    sha = lambda v: hashlib.sha256(",".join(map(str, ends.get(v, []))).encode()).hexdigest()
    return sorted(((low[v], depth[v], -1 if up[v] is None else low[up[v]], n[v], kids[v], leaves[v], saved[v], sha(v)) for v in n))


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def plain(spark, rows, **kw):
    turns = numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return rows_of(prefix_trie(turns, turns.select("conv_id").distinct(), **kw))


def random_rows(rng, n, longest, kinds):
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", f"text {rng.randrange(kinds)}" + " more" * rng.randrange(2)) for t in range(rng.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("shard_rows", [7, 20_000])
def test_random_tries(spark, shard_rows):
    rows = random_rows(random.Random(shard_rows), 300, 9, 3)
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(60) for t in range(4)]
    assert plain(spark, rows, shard_rows=shard_rows) == brute(sequences(rows))


def test_long_conversations(spark):
    """Conversations of several segments that part at, before and behind their borders, copies and beginnings of others."""
    rng = random.Random(9)
    base = [("user", f"turn {t} " + "w " * rng.randrange(4)) for t in range(700)]
    convs = {}
    for c, at in enumerate([0, 1, 63, 64, 65, 100, 127, 128, 129, 300, 511, 512, 513, 640, 699, 700]):
        convs[3 * c] = base[:at] + [("user", f"own {c} {t}") for t in range(rng.randrange(150))]
        convs[3 * c + 1] = base[:at]
        convs[3 * c + 2] = list(convs[3 * c])
    convs |= {100 + k: base[:640] + [("assistant", f"leaf {k % 5}")] for k in range(20)}
    rows = [(c, t, *turn) for c, own in convs.items() for t, turn in enumerate(own)]
    expected = brute({c: own for c, own in convs.items() if own})
    assert plain(spark, rows, shard_rows=5) == expected
    assert plain(spark, rows) == expected


def test_rebuilt_conversations(spark):
    """Donors that are short, absent or too long; null turns, roles, texts and ids; conversations that end up turnless."""
    rng = random.Random(3)
    rows = random_rows(rng, 90, 7, 4)
    rows = [r for r in rows if r[0] not in (40, 60)] + [(200 + c, 0, "user", "only") for c in range(30)] + [(260, None, None, None), (260, 0, "user", None), (260, None, None, ""), (None, 1, "user", "nobody"), (261, 5, None, "x"), (262, -3, "", ""), (262, -3, "", "")]
    rows += [(300 + c, t, "user", "the very same conversation") for c in range(40) for t in range(3)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", place int, words string, n int").repartition(4)
    got = rows_of(prefix_trie(*rebuilt_turns(numbered_turns(frame)), shard_rows=11))
    assert got == brute(rebuilt(sequences(rows)))
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)  # some have no turns


def test_odd_tables(spark):
    assert plain(spark, []) == []
    long_text = "word " * 500_000
    rows = [(5, 0, "user", long_text), (6, 0, "user", long_text), (7, 0, "user", long_text + "end")]
    assert plain(spark, rows) == brute(sequences(rows))
