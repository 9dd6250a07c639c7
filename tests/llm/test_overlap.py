"""The pipeline's near-duplicate stage against a brute force over Jaccard similarities."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_text import Sets, frame

from panelworks.llm import overlap, simhash
from panelworks.llm.common import row_keys


def shingle_set(t, n=5):
    ws = (t or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) or frozenset([tuple(ws)] if ws else [])


def near(a, b, similarity=0.8):
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def classes(sets):
    s, distinct = Sets(), list(dict.fromkeys(sets))
    for i, a in enumerate(distinct):
        for b in distinct[i:]:
            if near(a, b):
                s.join(a, b)
    return {x: s.root(x) for x in distinct}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        words[at : at + 1] = r.choice([[], [f"new{r.randrange(1000)}"], [words[at], "more"]])
        words = words or ["left"]
    return " ".join(words)


def texts(seed, n=300):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + r.choice("uvw")
    common = [word() for _ in range(40)]
    bases = [[word() for _ in range(r.choice([8, 30, 60, 120, 400]))] + common * (i % 2) for i in range(12)]
    out = [r.choice([None, "", " ", "a", "A b", "a  b", "a b c d e", "A b c d E\n", "x " * r.randrange(14)]) for _ in range(n // 5)]
    out += [edited(r, b := r.choice(bases), r.randrange(0, 2 + len(b) // 30)) for _ in range(n)]
    return out + [t.upper() for t in out[-5:] if t]


def rowwise(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=repr)


def brute(docs):
    of, groups = classes([shingle_set(t) for _, t in docs]), {}
    for d, t in docs:
        groups.setdefault(of[shingle_set(t)], []).append((d, t))
    return groups.values()


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_one_against_jaccard(spark, seed):
    r = random.Random(seed)
    docs = [(i, t) for i, t in enumerate(texts(seed))]
    r.shuffle(docs)
    got = simhash.keep_one(frame(spark, docs).repartition(7))
    assert got.columns == ["doc_id", "text", "doc", "version"]
    assert rowwise(got) == sorted((min(g) for g in brute(docs)), key=repr)
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_null_and_repeated_ids_by_row(spark):
    r = random.Random(4)
    docs = [(r.choice([None, None, 1, 2, 3]), t) for t in texts(4, 120)]
    docs += docs[:20]
    got = rowwise(simhash.keep_one(frame(spark, docs)))
    groups = list(brute(docs))
    assert len(got) == len(groups)
    for g in groups:
        mine = [x for x in got if x in g]
        least = min((d is None, d or 0) for d, _ in g)
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least


def connected(made, sets):
    s = Sets()
    for a, b in made:
        s.join(sets[a], sets[b])
    return s


def named_sets(docs):
    memo = overlap.WordHashes()
    return {overlap.node_of(overlap.shingles((t or "").encode(), 5, memo)): shingle_set(t) for t in docs}


@pytest.mark.parametrize("part, part_sets", [(1 << 20, 1 << 12), (500, 7)])
def test_parts_of_groups_meet(spark, part, part_sets):
    docs = frame(spark, list(enumerate(texts(5)))).select(row_keys().alias("row"), "text")
    nodes = simhash.printed(docs, 5).drop("row").dropDuplicates(["node"])
    groups = nodes.select("node", "size", F.lit(1).cast("bigint").alias("group"))
    made = overlap.links(overlap.texts_of(docs, groups, 5), groups, 5, 0.8, part, part_sets).collect()
    sets = named_sets(texts(5))
    assert made and all(near(sets[a], sets[b]) for a, b in made)
    s, of = connected(made, sets), classes(list(sets.values()))
    assert all((s.root(a) == s.root(b)) == (of[a] == of[b]) for a in of for b in of)


@pytest.mark.parametrize("home, visit", [(1 << 14, 1 << 16), (9, 13)])
def test_tiles_of_sets(spark, home, visit):
    """Whatever the number of tasks, links connect exactly what fingerprints and sizes allow."""
    docs = frame(spark, list(enumerate(texts(6)))).select(row_keys().alias("row"), "text")
    nodes = simhash.printed(docs, 5).drop("row").dropDuplicates(["node"])
    rows = [r for r in nodes.collect() if r["size"] >= 4]
    made = [(r.a, r.b) for r in simhash.set_links(nodes, 0.8, home, visit).collect()]
    prints = {r.node: [r[f"p{i}"] % (1 << 64) for i in range(simhash.LANES)] for r in rows}
    size = {r.node: r["size"] for r in rows}
    apart = lambda a, b, n: sum((x ^ y).bit_count() for x, y in zip(prints[a][:n], prints[b][:n], strict=True))
    close = lambda a, b: min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) - 1e-9 and apart(a, b, 2) <= simhash.NEAR and apart(a, b, 4) <= simhash.RADIUS
    assert made and all(close(a, b) for a, b in made) and (home == 9 or len(made) < len(rows))
    s, t = Sets(), Sets()
    for a, b in made:
        s.join(a, b)
    for a in prints:
        for b in prints:
            if close(a, b):
                t.join(a, b)
    assert all((s.root(a) == s.root(b)) == (t.root(a) == t.root(b)) for a in prints for b in prints)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_pipeline_stage_finds_all_near_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    got = {r.doc_id for r in stage(spark, docs, d).collect()}
    assert got == {min(i for i, _ in g) for g in brute([(r.doc_id, r.text) for r in docs.collect()])}
