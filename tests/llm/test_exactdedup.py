"""Exact dedup by chunk recipes against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelworks.llm import exactdedup
from panelworks.llm.common import join_groups


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def corpus(seed=1):
    r = random.Random(seed)
    words = ["and", "the", "barrier", "fence", "end", "漢字", "字漢歩" * 9, "😀", "x" * 90, "Door", "apple,"]
    made = [" ".join(r.choice(words) for _ in range(r.randrange(0, 90))) for _ in range(60)]
    made += [r.choice(made).replace(" ", r.choice(["\n", "\t ", "  ", " "])) for _ in range(60)]
    made += [made[3] + "z", made[3][:-1], "q" * 5000, "q" * 5000, "q" * 4999, " ", "\n\t", "", None, None, "a  b", " a b", "a b "]
    made += ["hot copy of a text"] * 200
    return list(enumerate(made))


def brute(docs):
    of = defaultdict(list)
    for i, t in docs:
        of[norm(t)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in of.items()}
    return sorted(((i, least[norm(t)], len(of[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in docs), key=repr)


@pytest.mark.parametrize("least,most", [(1024, 16_384), (8, 40), (1, 1)])
def test_against_brute_force(spark, least, most):
    docs = corpus()
    got = exactdedup.duplicates(spark.createDataFrame(docs, "doc_id long, text string"), least=least, most=most).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(docs)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_chunks_make_the_text_and_meet_again_after_an_edit(spark):
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdefnrs") for _ in range(r.randrange(1, 9))) for _ in range(40_000))
    texts = [long, "Inserted words, " + long, "", "😀" * 5000, *(norm(t) for _, t in corpus())]
    cut = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(exactdedup.chunks(F.col("t"), 64, 512).alias("c")).collect()]
    assert ["".join(c) for c in cut] == texts and all(len(x) <= 512 for c in cut for x in c)
    assert len(set(cut[0]) & set(cut[1])) > 0.95 * len(cut[0])


def test_names_that_clash_are_drawn_anew(spark, monkeypatch):
    """With names of 2 x 3 bits chunks share names under most seeds; the groups are right all the same."""
    seeds = []
    plain = exactdedup.recipes
    monkeypatch.setattr(exactdedup, "recipes", lambda docs, seed, *a: seeds.append(seed) or plain(docs, seed, *a))
    texts = ["alpha and beta", "gamma end delta", "one fence two", "door and fence", "x and c", "y end f", "z and e", "u end a"]
    docs = list(enumerate(texts * 2 + ["single"]))
    got = exactdedup.duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bits=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(docs)
    assert len(seeds) > 1
    with pytest.raises(RuntimeError):
        exactdedup.duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bits=1)


def test_null_and_repeated_ids(spark):
    docs = [(None, "a b"), (7, "a\nb"), (7, "a b"), (7, "a b"), (None, "c"), (None, "c"), (9, None), (8, ""), (3, " ")]
    df = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(docs)], "doc_id int, text string, name int, size string")
    got = exactdedup.duplicates(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(docs)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    stay = exactdedup.keep_one(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id or -1, norm(r.text)) for r in stay.collect()) == [(-1, "c"), (3, " "), (7, "a b"), (8, "")]
    assert exactdedup.duplicates(df.limit(0)).count() == 0 and exactdedup.keep_one(df.limit(0)).count() == 0


def test_heavy_groups_are_joined_where_their_rows_are(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("id").alias("n"))
    got = join_groups(rows, groups, ["k"], "n", 1000)
    assert sorted((r.id, r.n) for r in got.collect()) == [(i, 700 if i < 700 else 1) for i in range(1000)]
    assert sum(r.n is None for r in join_groups(rows, groups.where("n > 1"), ["k"], "n", 1000).collect()) == 300
