"""Where benchmark items lie in texts, and shards of an id that many texts share."""

import random

from pyspark.sql import functions as F

from panelworks.llm import decontam, sharding


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_anchored_distances():
    r = random.Random(2)
    for _ in range(200):
        p, t = ([r.choice("abc") for _ in range(r.randrange(1, 9))] for _ in range(2))
        assert decontam.myers(p, t, anchored=True) == [distance(p, t[:n]) for n in range(1, len(t) + 1)]


def test_start_is_that_of_the_alignment():
    r = random.Random(3)
    item = [f"w{i}" for i in range(20)]
    index = decontam.Index([(1, item)], 0.2, 5)
    for _ in range(200):
        text = list(item)
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(1, len(text) - 1)
            text[at : at + 1] = r.choice([[], [text[at], "extra"], ["other"]])
        ahead = ["before"] * r.randrange(0, 6)
        (_, d, start, end, m), = decontam.occurrences(index, ahead + text + ["after"] * 4, decontam.WordHashes())
        assert distance(item, (ahead + text + ["after"] * 4)[start:end]) == d <= 4 and m == 20
        if text[:3] == item[:3] and text[-3:] == item[-3:]:
            assert start == len(ahead) and end == len(ahead) + len(text)


def test_slots_of_an_id_with_many_texts(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = sharding.shard(docs, shards=3).collect()
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len(got) == 3000
