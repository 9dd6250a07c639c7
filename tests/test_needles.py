"""The index of literals never keeps a pattern from a text that it matches."""

import random
import re

from pyspark.sql import functions as F

from panelworks.functions import needles, text as X, vocab

MORE = {"opt": r"ab?c", "set": r"[xy]z+", "none": r".*", "alt": r"\b(foo|bar baz|q[uv]x)\b|!!", "edge": r"\bend\b", "prefix": r"\b(abc|abd|abef)\b", "repeat": r"(?:hey ){2}you", "under": r"\ba_b\b"}


def texts():
    r = random.Random(4)
    words = ["who", "Who?", "you're", "_who_", "whom", "no", "nah,", "agree!", "100%", "touché", "touche", "TIL", "i've", "couldn't", "agree", "more", "as", "a", "http://x", "that's", "true", "I", "cannot", "can't", "ſure", "éwho", "ethically", "concerns",
             "abc", "abd", "ac", "yz", "foo", "bar", "baz", "qux", "qvx", "!!", "the_end", "end", "end.", "hey", "you", "a_b", "a-b", ">", "\n>", "not", "able", "to", "unable", "guess", "K", "İ", "privacy", "concern"]
    return ["", None] + [r.choice([" ", " ", "", "\n"]).join(r.choice(words) for _ in range(r.randrange(1, 14))) for _ in range(400)]


def test_needles_are_in_every_match():
    for p in [*vocab.CUES.values(), *vocab.REFUSALS, *MORE.values()]:
        found = needles.needles(p)
        for t in texts():
            folded = (t or "").lower()
            if found and re.search(p, folded, re.I | re.A):
                cut = set(re.split("[^a-z0-9_]+", folded))
                assert any((n.text in cut if n.whole else n.text in folded) and n.run in folded for n in found), (p, t)
    assert needles.needles(".*") is None and needles.needles(r"\bend\b") == {needles.Needle("end", True)} and len(needles.needles("ab?c")) == 1


def test_index_changes_no_result(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, t string")
    all_ = {**vocab.CUES, **MORE}
    folded = F.lower(F.coalesce("t", F.lit("")))
    by_index = needles.matches(folded, {n: (p, F.rlike(folded, F.lit("(?u)" + p))) for n, p in all_.items()})
    plain = F.array_compact(F.array(*[F.when(F.rlike(folded, F.lit("(?u)" + p)), F.lit(n)) for n, p in all_.items()]))
    refusal = [F.rlike(X.blank("t"), F.lit("(?iu)" + p)) for p in vocab.REFUSALS]
    got = df.select("t", by_index.alias("a"), plain.alias("b"), X.refuses("t").alias("c"), F.exists(F.array(*refusal), lambda x: x).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and any(r.c for r in got) and len({tuple(r.a) for r in got}) > 20


def test_words_of_ascii_letters(spark):
    """As RE2 reads the patterns, which the SQL of cue_frequency has as they are; without ascii_words as the patterns are meant."""
    said = [("la noñiedoja", "disagreement", ""), ("ñyes, touché", "agreement", "concession"), ("touchéx", "concession", ""), ("so\r> it", "", None), ("so\n> it", "quotes_parent", "quotes_parent"),
            ("YOU\u212a", "second_person", ""), ("lin\u212a", "", "evidence_marker"), ("x\u017fource", "evidence_marker", ""), ("\u017fource", "", "evidence_marker"), ("T\u0130L", "", "concession"), (None, "", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(said)], "i int, t string")
    got = df.select("i", F.array_join(X.cues("t", ascii_words=True), ";").alias("a"), F.array_join(X.cues("t"), ";").alias("u")).orderBy("i").collect()
    assert [r.a for r in got] == [a for _, a, _ in said]
    assert [r.u for r, (_, _, u) in zip(got, said, strict=True) if u is not None] == [u for _, _, u in said if u is not None]
