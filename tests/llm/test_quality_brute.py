"""The classifier against a network written as plain loops, and what it learns from."""

import math
import random

import numpy as np
from test_text import frame

from panelworks.llm import quality


def plain_score(net, data: bytes) -> float:
    size, step, width, pad = quality.CHUNK, quality.STEP, quality.WIDTH, 256
    starts = [0]
    while starts[-1] + size < len(data):
        starts.append(starts[-1] + step)
    scores = []
    for s in starts:
        row = list(data[s : s + size])
        row += [pad] * (size - len(row))
        best = []
        for f in range(quality.FILTERS):
            best.append(max(sum(float(net.tables[j][row[p + j]][f]) for j in range(width)) for p in range(size - width + 1)))
        h0 = [max(0.0, b + float(net.bias[f])) for f, b in enumerate(best)]
        h1 = [max(0.0, sum(h0[i] * float(net.w1[i][j]) for i in range(quality.FILTERS)) + float(net.b1[j])) for j in range(quality.HIDDEN)]
        scores.append(sum(h * float(w) for h, w in zip(h1, net.w2, strict=True)))
    z = net.out[0] * sum(scores) / len(scores) + net.out[1] * max(scores) + net.out[2] * min(scores) + net.out[3]
    return 1 / (1 + math.exp(-z))


def corpus(n=240):
    r = random.Random(9)
    good = ["meadow", "river", "quiet", "garden", "evening", "letters"]
    bad = ["buy!!", "$$$", "click", "win", "cheap", "now!!!"]
    text = lambda i: " ".join(r.choice(good if i % 3 else bad) for _ in range(r.choice([1, 3, 40, 300])))
    return [(i, text(i)) for i in range(n)]


def test_scores_against_plain_loops(spark):
    docs = corpus()
    df = frame(spark, docs + [(900, None), (901, ""), (902, "é" * 700), (3, docs[3][1])])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    net = quality.fit(df, labels, steps=60)
    got = {(r.doc_id, round(r.score, 9)) for r in quality.score(df, net).collect()}
    some = [*docs[:6], (900, ""), (901, ""), (902, "é" * 700)]
    for i, t in some:
        near = [s for d, s in got if d == i]
        assert len(near) == 1 and abs(near[0] - plain_score(net, t.encode())) < 1e-4
    assert all(len({s for d, s in got if d == i}) == 1 for i, _ in docs)


def test_whole_texts_are_learned_from(spark):
    """The sample is bounded in rows and bytes; texts in it are whole."""
    docs = [(i, f"start {i} " + "long words " * (20 * i) + "end") for i in range(60)]
    df = frame(spark, docs + [(7, "again")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in docs] + [(1, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.labelled_sample(df, labels).collect()
    assert {(r.doc_id, r.text) for r in rows} <= {*docs, (7, "again")} and not any(quality_fold(r.doc_id) for r in rows)
    assert {r.doc_id for r in rows} == {i for i, _ in docs if not quality_fold(i)}
    few = quality.labelled_sample(df, labels, sample=10, sample_bytes=9000).collect()
    assert 0 < len(few) <= 10 and sum(len(r.text) for r in few) <= 9000 and {(r.doc_id, r.text) for r in few} <= {*docs, (7, "again")}


def quality_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_labels_of_one_class(spark):
    df = frame(spark, corpus(30))
    labels = lambda q: spark.createDataFrame([(i, q, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for q, want in ((1, 0.982), (0, 0.018)):
        assert {round(r.score, 3) for r in quality.score(df, quality.fit(df, labels(q))).collect()} == {want}
    none = quality.fit(df, labels(None))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5} and np.allclose(none.out, 0)
    assert quality.score(df.limit(0), none).count() == 0
