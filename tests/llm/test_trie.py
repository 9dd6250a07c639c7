"""Prefix tries against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelworks.llm import trie

ROWS = "conv_id long, turn long, role string, text string"


def key(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def own_turns(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in of.items()}


def made_anew(of):
    out = {}
    for c in of:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = of.get(base, [])[:h] + of[c][h:]
    return out


def brute(of):
    nodes = defaultdict(list)
    for c, turns in of.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for seq in nodes:
        if seq:
            kids[seq[:-1]].append(seq)
    sums = {}
    for seq in sorted(nodes, key=len, reverse=True):
        leaves, saved = (sum(sums[k][i] for k in kids[seq]) for i in (0, 1))
        sums[seq] = (leaves or 1, saved + (len(nodes[seq]) - 1) * (len(seq[-1][1]) if seq else 0))
    ends = lambda seq: hashlib.sha256(",".join(str(c) for c in sorted(nodes[seq]) if len(of[c]) == len(seq)).encode()).hexdigest()
    return sorted(((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(kids[s]), *sums[s], ends(s)) for s, m in nodes.items()), key=repr)


def corpus(seed, convs=40, words=3):
    r = random.Random(seed)
    rows = []
    for c in range(0, convs * 10, 10):
        n = r.choice([0, 1, 2, 3, 5, 8, 14])
        rows += [(c, t, r.choice(["user", "user", None]), r.choice(["a", "bb", "", None][:words])) for t in range(n)]
    rows += [(7, t, "user", "a") for t in range(17)] + [(8, t, "user", "a") for t in range(17)] + [(9, t, "user", "a") for t in range(16)]
    rows += [(11, None, "user", "first"), (11, 3, "x", "tie"), (11, 3, "x", "tie"), (11, 3, "y", "tie"), (11, -1, "z", "é😀")]
    rows += [(None, 1, "user", "of none"), (-250, 0, "user", "a"), (-250, 1, "u", "b"), (-200, 0, "user", "a"), (-200, 1, "q", "b"), (1205, 0, "user", "no base")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels,most", [(5, 20_000), (0, 20_000), (2, 40)])
def test_against_brute_force(spark, levels, most):
    rows = corpus(1)
    got = trie.of_conversations(spark.createDataFrame(rows, ROWS), levels=levels, local_turns=most)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(own_turns(rows))


@pytest.mark.parametrize("seed", [2])
def test_rebuilt_against_brute_force(spark, seed):
    rows = corpus(seed, words=2)
    conv = F.col("conv")
    turns, lengths = trie.rebuilt(trie.turn_rows(spark.createDataFrame(rows, ROWS)), conv - conv % 100, F.crc32(conv.cast("string")) % 6)
    want = made_anew(own_turns(rows))
    assert {r.conv: r.len for r in lengths.collect()} == {c: len(t) for c, t in want.items()}
    assert sorted(map(tuple, trie.prefix_trie(turns, lengths).collect()), key=repr) == brute(want)


def test_one_conversation_holds_most_turns(spark):
    """Numbered over ranges; alike rows, a third of all, among them."""
    rows = [(5, t, "user", f"turn {t}") for t in range(900)] + [(5, 2000, "user", "same")] * 600 + [(6, t, "user", f"turn {t}") for t in range(100)] + [(7, 0, "user", "other")]
    df = spark.createDataFrame(rows, ROWS).repartition(8)
    numbered = trie.turn_rows(df)
    assert sorted((r.conv, r.pos) for r in numbered.collect()) == [(5, i) for i in range(1, 1501)] + [(6, i) for i in range(1, 101)] + [(7, 1)]
    assert sorted(map(tuple, trie.of_conversations(df, levels=3).collect()), key=repr) == brute(own_turns(rows))


def test_copies_columns_that_clash_and_no_rows(spark):
    rows = [(c, t, "user", f"t{t}", "mine", 3, 1) for c in range(120) for t in range(4)] + [(500, 0, "user", "t0", "mine", 3, 1)]
    df = spark.createDataFrame(rows, ROWS + ", key string, pos int, n int")
    got = trie.of_conversations(df)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(own_turns([r[:4] for r in rows]))
    assert trie.of_conversations(df.limit(0)).count() == 0


def test_long_lists_of_ends_are_hashed_in_pieces(spark):
    ends = spark.range(10_000).selectExpr("1L AS depth", "IF(id % 3 = 0, 1L, 2L) AS node", "id AS conv").repartition(7)
    got = {r.conv_id: r.ends_sha256 for r in trie.ends_digests(ends).collect()}
    assert got == {n: hashlib.sha256(",".join(str(i) for i in range(10_000) if (i % 3 == 0) == (n == 1)).encode()).hexdigest() for n in (1, 2)}
