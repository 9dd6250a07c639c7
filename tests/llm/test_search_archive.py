"""Nearest neighbours, WARC archives and the pipeline."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.llm import ann, queries, warc


def exact(rows, k=20, every=20):
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {i: [j for _, j in sorted((-float(w @ v), j) for j, w in fine if j != i)[:k]] for i, v in fine if i % every == 0}


def search(spark, rows, **options):
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for x in ann.nearest(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    return got


def test_ties_and_unusable_vectors(spark):
    r = random.Random(1)
    base = [r.gauss(0, 1) for _ in range(8)]
    rows = [(i, base if i % 3 else [r.gauss(0, 2) for _ in range(8)]) for i in range(200)]
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (360, [1.0] * 7 + [None]), (None, base), (380, [float("inf")] * 8), (400, [1.0])]
    fine = [x for x in rows if x[0] != 400]
    want, vector = exact(fine), {i: np.array(v) for i, v in fine if i is not None and v is not None and None not in v}
    got = search(spark, rows)
    assert search(spark, rows, slice_rows=3) == got  # slices change nothing
    for found in (got, search(spark, rows, block=40)):
        assert set(found) == set(want) and all(len(v) == 20 == len(set(v)) for v in found.values())
        assert np.mean([len(set(found[i]) & set(v)) / 20 for i, v in want.items()]) >= 0.95
        for i, v in found.items():  # nearest first, ties by id; of equal vectors those of smallest id
            order = [(-round(float(vector[j] @ vector[i]), 9), j) for j in v]
            assert order == sorted(order)
            same = [j for j in v if j % 3 and j < 200]
            assert same == [j for j in range(200) if j % 3 and j != i][: len(same)]
    assert search(spark, rows[:0]) == {} and search(spark, rows[:5]) == {0: exact(rows[:5])[0]}


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e4])
def test_recall(spark, scale):
    g = np.random.default_rng(2)
    x = g.normal(size=(1500, 24)) * g.uniform(0.2, 3, size=(1500, 1)) * scale
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    want, got = exact(rows), search(spark, rows, block=500)
    assert np.mean([len(set(got[i]) & set(v)) / 20 for i, v in want.items()]) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_recall_on_embeddings(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = exact(rows)
    got = {}
    for x in queries.op8_nearest(spark, d).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert set(got) == set(want) and np.mean([len(got[i] & set(v)) / 20 for i, v in want.items()]) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_few_vectors_are_verified(spark):
    """Counts of collisions choose the candidates: recall over all queries, and the share of vectors that are verified."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()])
    made = ann.block_answers(table, F.col("vec_id") % 20 == 0, 20, 8192, 1 << 16).persist()
    got = {}
    for x in made.collect():
        got.setdefault(x.query_id, []).append((-x.score, x.vec_id))
    recall = np.mean([len({i for _, i in sorted(got[q])[:20]} & set(v)) / 20 for q, v in want.items()])
    share = made.agg(F.sum("verified") / F.sum("rows")).first()[0]
    print(f"recall {recall:.3f}, verified {share:.3f}")
    assert recall >= 0.9 and share < 0.15


def test_repeated_ids_lengths_and_magnitudes(spark):
    r = random.Random(6)
    base = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(1, 90)]
    again = [(20, [9.0] + [0.0] * 4), (20, [-9.0] + [0.0] * 4), (33, [0.5] * 5), (33, [0.5] * 5), (0, [1.0, 2.0]), (100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(base[:19] + base[20:] + again, "vec_id long, embedding array<double>").repartition(5)
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in ann.nearest(df, F.col("vec_id") % 20 == 0, k=100).orderBy("query_id", "rank").collect()]
    fine = [(i, np.array(v)) for i, v in base[:19] + base[20:] + again[:4]]
    want = []
    for q in (20, 40, 60, 80):
        v = np.array([-9.0, 0, 0, 0, 0]) if q == 20 else next(w for i, w in fine if i == q)
        best = sorted((-float(np.einsum("j,j->", w, v)), i) for i, w in fine if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
    for scale in (1e200, 1e-310):
        rows = [(i, [float(x) * scale for x in v]) for i, v in base]
        assert len(search(spark, rows)[20]) == 20
    assert search(spark, [(i, [1.0] * i) for i in range(1, 30)]) == {}


INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n"
PAGES = [(1, "http://a/", "x" * 150), (2, None, "x" * 150), (3, "u v", INNER * 3), (4, "u", None), (None, "u", "x" * 150), (5, "u", "é\n\r\n"), (5, "u", "é\n\r\n"), (6, "q", ""), (7, "r", "y" * 99), (8, "s", "y" * 99)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame([(*p, "e") for p in PAGES], "page_id long, url string, html string, path string")
    p = str(tmp_path / "w")
    warc.write_warc(df, p, per_file=3, compression=compression)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.target) for r in warc.read_warc(spark, p).collect()), key=repr)
    urn = lambda i: f"<urn:page:{'null' if i is None else i}>"
    want = [(urn(i), "revisit" if i in (2, None) else "response", urn(1) if i in (2, None) else None, len((h or "").encode()), u.replace(" ", "%20") if u else None) for i, u, h in PAGES]
    assert got == sorted(want, key=repr)
    assert all(r.payload_digest == r.header_digest for r in warc.read_warc(spark, p).collect())
    warc.write_warc(df.limit(0), p + "0")
    assert warc.read_warc(spark, p + "0").count() == 0


def record(body, head=b""):
    return b"WARC/1.1\r\nWARC-Type: response\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (head, len(body), body)


@pytest.fixture
def ranges(spark):
    """ranges(n): archives are read n bytes at a time."""
    name = "spark.sql.files.maxPartitionBytes"
    yield lambda n: spark.conf.set(name, n)
    spark.conf.unset(name)


@pytest.mark.parametrize("size", [1 << 27, 97, 350, 1000])
def test_chain_rejects_magic_in_payloads(spark, tmp_path, ranges, size):
    bodies = [(INNER * 2).encode() + b"\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\nhi", b"", b"\n\r\n\r\nWARC/1.0\r\n" * 40, b"x" * 2500, INNER.encode() * 30, b"\xff\xfe\r\n\n" * 50]
    heads = [b"", b"X: %s\r\n" % (b"y" * 60), b"", b"", b"A: b\r\n C: d\r\n", b"", b""]
    files = {"a.warc": [0, 1, 2, 3, 4, 5, 6], "b.warc": [5, 5, 2], "c.warc": [2], "d.warc": [4, 4, 3, 6, 0], "e.warc": []}
    want = []
    for name, numbers in files.items():
        data = b""
        for i in numbers:
            payload = bodies[i].partition(b"\r\n\r\n")[2] if b"\r\n\r\n" in bodies[i] else bodies[i]
            want.append((len(data), len(payload), hashlib.sha256(payload).hexdigest()))
            data += record(bodies[i], heads[i])
        (tmp_path / name).write_bytes(data)
    ranges(size)
    got = [(r.offset, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [1 << 27, 900])
def test_round_trip_by_ranges(spark, tmp_path, ranges, size):
    pages = [(i, f"http://h/{i}", [INNER * (i % 5), f"page {i} " * 30, "same " * 40, None, "é\r\n\r\n" * (i % 9)][i % 5]) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    p = str(tmp_path / "w")
    warc.write_warc(df, p, per_file=50, compression="none")
    ranges(size)
    rows = warc.read_warc(spark, p).collect()
    assert len({(r.file, r.offset) for r in rows}) == 120 == len({r.record_id for r in rows})
    of = {r.record_id: r for r in rows}
    for i, _, html in pages:
        r = of[f"<urn:page:{i}>"]
        assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), hashlib.sha256((html or "").encode()).hexdigest())


def test_a_header_of_a_megabyte_over_a_border(spark, tmp_path, ranges):
    heads = [b"".join(b"X-%d: %s\r\n" % (i, b"v" * 100) for i in range(10_000)), b""]
    data = record(b"one", heads[1]) + record(b"two", heads[0]) + record(b"three")
    (tmp_path / "a.warc").write_bytes(data)
    ranges(600_000)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r.payload_digest for r in got] == [hashlib.sha256(x).hexdigest() for x in (b"one", b"two", b"three")]


def test_pointer_jumping():
    assert len(warc.reachable(np.empty(0, int), np.empty(0, int))) == 0 and warc.reachable(np.array([5]), np.array([9])).tolist() == [9]
    r = random.Random(1)
    for _ in range(50):
        offsets = np.array(r.sample(range(0, 300), 40))
        nexts = np.array([r.choice([*[o for o in offsets if o > x], 300, 301]) for x in offsets])
        want = []
        for at in nexts.tolist():
            while at in offsets:
                at = int(nexts[offsets.tolist().index(at)])
            want.append(at)
        assert warc.reachable(offsets, nexts).tolist() == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_native import brute_capacity, fill
    from test_overlap import brute
    from test_quality_brute import plain_score

    from panelworks.llm import decontam, quality, sharding
    from panelworks.llm.common import materialize

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(materialize(stage(spark, held[-1], d), "t"))
    rows = [[tuple(r) for r in h.collect()] for h in held]
    assert all(h.columns == docs.columns for h in held[:5])
    # Quality: the network's scores, some of them by plain loops.
    net = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scores = net.predict([(r[1] or "").encode() for r in rows[0]])
    short = sorted(range(len(rows[0])), key=lambda i: len(rows[0][i][1] or ""))[:6]
    assert all(abs(scores[i] - plain_score(net, (rows[0][i][1] or "").encode())) < 1e-4 for i in short)
    good = [r for r, p in zip(rows[0], scores, strict=True) if p >= 0.3]
    assert sorted(rows[1]) == sorted(good)
    # Near duplicates: the smallest id of each group by Jaccard similarity.
    assert sorted(r[0] for r in rows[2]) == sorted(min(i for i, _ in g) for g in brute([r[:2] for r in good]))
    # Decontamination: the edit distance of each item to each text.
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = [r for r in rows[2] if not any(len(p) >= 5 and min(decontam.myers(p, decontam.words(r[1])), default=99) <= int(len(p) * 0.2 + 1e-9) for p in items)]
    assert sorted(rows[3]) == sorted(clean)
    # Mixing: whole documents, each as often as its neighbours or once more, within a document of each source's target.
    source, words = docs.columns.index("source"), lambda r: len((r[1] or "").split())
    size, taken, longest = Counter(), Counter(), Counter()
    for r in clean:
        size[r[source]] += words(r)
        longest[r[source]] = max(longest[r[source]], words(r))
    for r in rows[4]:
        taken[r[source]] += words(r)
    order = sorted(size, key=lambda s: (s is None, s))
    want = fill(dict(size), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), 2)
    copies = Counter(rows[4])
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in size)
    for s in size:
        times = {copies[r] for r in clean if r[source] == s and words(r)}
        assert max(times) - min(times) <= 1
    # Sharding: equal texts together, the largest shard as small as contiguous shards in the order of keys allow.
    assert len(rows[5]) == len(rows[4]) and sorted(r[0] for r in rows[5]) == sorted(r[0] for r in rows[4])
    placed = sharding.shard(held[4], shards=40).collect()
    groups, load = Counter(), Counter()
    for r in placed:
        groups[r.key] += r["size"]
        load[r.shard] += r["size"]
    assert sorted((r.doc_id, r.shard, r.slot) for r in placed) == sorted((r.doc_id, r.shard, r.slot) for r in held[5].collect())
    assert max(load.values()) <= brute_capacity([n for _, n in sorted(groups.items())], 40)
