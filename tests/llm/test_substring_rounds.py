"""Rounds of recompression: high symbols reveal long repeats, and blocks of long texts change nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import brute_windows, frame, plain

from panelworks.llm import substring


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_a_long_repeat_is_a_few_symbols(spark):
    passage = words(1, 1000)
    docs = [(1, " ".join(words(2, 130) + passage + words(3, 77))), (2, " ".join(words(4, 41) + passage + words(5, 200))), (3, " ".join(words(6, 500))), (4, " ".join(words(6, 500)))]
    found = substring.long_repeats(substring._named(frame(spark, docs)), 20).where("settled").select("doc", "first", "count").collect()
    of = lambda d: [(r["first"], r["count"] + 19) for r in found if r.doc == d]
    assert not of(1) and not of(3)
    inside = of(2)
    # One symbol stands for hundreds of words, a few dozen rows for all of the passage.
    assert max(n for _, n in inside) >= 200 and len(inside) <= 60
    assert all(41 <= a and a + n <= 41 + 1000 for a, n in inside)
    assert len({w for a, n in inside for w in range(a, a + n)}) >= 850
    # A copy of a whole document is one symbol.
    assert (0, 500) in of(4)


def test_nothing_below_a_settled_symbol_is_sent(spark, monkeypatch):
    passage = words(1, 1000)
    docs = [(i, " ".join(words(10 + i, 60) + passage + words(40 + i, 60))) for i in range(6)]
    sent = []
    whole = substring._resolve
    monkeypatch.setattr(substring, "_resolve", lambda rows: sent.append(rows.agg(F.count_if(F.col("doc") > 0), F.max("count")).first()) or whole(rows))
    got = plain(substring.deduplicate(frame(spark, docs)))
    assert got == brute_windows(docs)
    long, anchors, windows = (s[0] for s in sent)
    # Five later copies have 5 x 981 windows in the passage and some 800 anchors.
    assert long <= 5 * 60 and anchors < 5 * (120 // 5 + 60) and windows < 5 * 150


@pytest.mark.parametrize("size", [12, 20, 60])
def test_blocks_of_long_texts(spark, size):
    text = words(7, 450_000)
    text[200_000 - 30 : 200_000 + 30] = text[100:160]  # over a border of blocks
    text[399_900:400_500] = text[1000:1600]
    text[430_000:430_400] = ["same"] * 400
    docs = [(1, " ".join(text[150:3000])), (2, "  ".join(text)), (3, None), (4, " ".join(text[199_950:200_060]))]
    assert plain(substring.deduplicate(frame(spark, docs), size=size)) == brute_windows(docs, size)


def test_split_by_megabytes(monkeypatch):
    monkeypatch.setattr(substring, "_BYTES", 7)
    for t in (b"", b" ", b"one", b"a b\tc\nd  e\x0bf", b"long-word-without-end next \r\n last ", "é日本 x".encode() * 9):
        assert [w for ws in substring._split(t) for w in ws] == t.split()


def test_high_symbols_agree_in_all_contexts():
    memo = substring.WordHashes()
    code = lambda ws: substring.hashed([w.encode() for w in ws], memo)
    passage = words(1, 600)
    seen = []
    for i in range(3):
        codes = code(words(20 + i, 100) + passage + words(30 + i, 100))
        doc = np.zeros(len(codes), np.int64)
        seen.append({int(n): int(b - a) for a, b, ns, _ in [(*x[:2], x[2], x[3]) for x in substring.high_symbols(codes, doc, 20)] for a, b, n in zip(a, b, ns, strict=True)})
    both = set(seen[0]) & set(seen[1]) & set(seen[2])
    assert both and max(seen[0][n] for n in both) >= 100
