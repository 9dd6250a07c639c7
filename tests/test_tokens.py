"""Token counts against a plain merge loop."""

import base64
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelworks.functions import tokens


def vocabulary(seed, n=400):
    r = random.Random(seed)
    found = [bytes([b]) for b in range(256)]
    for _ in range(n):
        joined = r.choice(found[97:123] if r.random() < 0.5 else found) + r.choice(found[97:123] if r.random() < 0.5 else found)
        if joined not in found and len(joined) < 12:
            found.append(joined)
    return {p: i for i, p in enumerate(found)}


def plain(word, ranks):
    if word in ranks:
        return 1
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return len(parts)


RANKS = vocabulary(3)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40) | st.text("abcdefz ", max_size=60).map(str.encode))
def test_pieces_match_a_plain_merge_loop(word):
    assert tokens.pieces(word, RANKS) == (plain(word, RANKS) if word else 0)


def test_counts_over_a_table(spark, tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for p, i in RANKS.items()))
    r = random.Random(1)
    texts = ["", None, "it's  a\n\ntest 123!", "é😀", "z" * 5000, *(" ".join("".join(r.choice("abcxyz1.'") for _ in range(r.randrange(0, 9))) for _ in range(20)) for _ in range(60))]
    count = tokens.token_counter(spark, str(path))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", count(F.col("t")).alias("n")).collect()
    import regex

    assert all(x.n == sum(plain(w.encode(), RANKS) for w in regex.findall(tokens.WORDS, x.t or "")) for x in got) and len(got) == len(texts)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    c = tokens.Counter(RANKS)
    assert [c.count(w) for w in ("ab", "cd", "ef", "gh", "ab")] == [tokens.pieces(w.encode(), RANKS) for w in ("ab", "cd", "ef", "gh", "ab")] and len(c.memo) <= 3
