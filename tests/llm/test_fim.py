"""Fill-in-middle against plain Python, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelworks.llm import fim

MARKS = ("<P>", "<S>", "<M>")


def numbers(doc_id, seed=7):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def brute(doc_id, text, pattern=fim.GRAMMARS["line"].pattern, rate=100, spm=50, seed=7):
    text = text or ""
    pieces = re.findall(pattern, text)
    h1, h2, h3, h4 = numbers(doc_id, seed)
    a, b = sorted((h1 % (len(pieces) + 1), h2 % (len(pieces) + 1)))
    pre, mid, suf = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return len(pieces), "plain", None, None, text
    if h4 % 100 < spm:
        return len(pieces), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(pieces), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    r = random.Random(3)
    alphabet = ["a", "b", " ", "\n", "\n", "\r", "\t", "é", "😀", " ", "<", "P", ">", "𝒳", "\x0b", "\x00"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 40))) for _ in range(300)]
    return made + [None, "", "\n", "\n\n", "x", "x\n", "\nx", "a<P>b\n", "<S>", "q<M>\n", "<P\n>", "<\nS>", "😀\n😀", "long\n" * 50_000, "no end " * 40_000, "\n\n\nx\n\n\n\ny"]


@pytest.mark.parametrize("name", sorted(fim.GRAMMARS))
def test_units_are_those_of_the_pattern(spark, name):
    found = spark.createDataFrame([(t,) for t in texts()], "text string").select("text", fim.units(F.col("text"), name).alias("u")).collect()
    for r in found:
        assert r.u == re.findall(fim.GRAMMARS[name].pattern, r.text or "") and "".join(r.u) == (r.text or "")


@pytest.mark.parametrize("name,rate,spm,seed", [("line", 100, 50, 7), ("character", 60, 20, 1), ("word", 100, 100, 2), ("token", 90, 0, 3), ("paragraph", 100, 50, 4)])
def test_against_brute_force(spark, name, rate, spm, seed):
    docs = list(enumerate(texts())) + [(None, "a\nb\nc\n"), (None, None), (5, "again\nhere\n"), (5, "again\nhere\n"), (-3, "minus\none")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    made = fim.transform(df, name, seed, rate, spm).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, t, *brute(i, t, fim.GRAMMARS[name].pattern, rate, spm, seed)) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr) == want
    assert all(r.back == (r.text or "") for r in made)


def test_columns_that_clash_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a\nb\n", "mine", 5, "x")], "doc_id long, text string, _fim string, n int, __fim string")
    made = fim.transform(df)
    assert made.columns == ["doc_id", "text", "_fim", "__fim", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert [(r._fim, r["__fim"], r.n) for r in made.collect()] == [("mine", "x", 2)]
    assert fim.transform(df.limit(0)).count() == 0


def test_sentinels_that_cannot_be_told_apart():
    for bad in (("<P>", "<P>", "<M>"), ("a", "ab", "c"), ("", "b", "c"), ("aba", "x", "y"), ("xy", "yz", "q")):
        with pytest.raises(ValueError):
            fim.Sentinels(*bad)
    assert fim.Sentinels("<|pre|>", "<|suf|>", "<|mid|>").all


def test_other_sentinels_round_trip(spark):
    marks = fim.Sentinels("[pre]", "[suf]", "[mid]")
    docs = [(i, t) for i, t in enumerate(["a\nb\nc\n", "x [suf] y\n", "<P>\n<S>\n", "[\np\nre]\n", "\n" * 9])]
    made = fim.transform(spark.createDataFrame(docs, "doc_id long, text string"), "character", sentinels=marks)
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"), marks)).collect()
    assert [r.back for r in sorted(got, key=lambda r: r.doc_id)] == [t for _, t in docs] and {r.form for r in got} > {"plain"}
