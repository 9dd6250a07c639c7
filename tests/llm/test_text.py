"""Substring dedup, token counts, SimHash, decontamination and the classifier against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from panelworks.llm import decontam, graph, quality, simhash, substring, tokencount

DOCS = "doc_id long, text string, doc string, version string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_windows(docs, size=20):
    place = lambda d, i: (d if d is not None else 1 << 63, i)
    ws = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in ws:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, place(d, i)), place(d, i))
    out = []
    for d, w in ws:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < place(d, i):
                gone[i : i + size] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def messy(seed, n=60):
    r = random.Random(seed)
    words = ["a", "b", "c", "d\n"]
    base = [r.choice(words) for _ in range(400)]
    kinds = [
        lambda: base[r.randrange(300) :][: r.randrange(10, 90)], lambda: ["x"] * r.randrange(0, 70), lambda: (base[50:60] * 9)[: r.randrange(15, 80)],
        lambda: [r.choice(words) for _ in range(r.randrange(0, 60))] + base[100:130] + ["é", " z"], lambda: base[:50] + [f"q{r.randrange(3)}"] + base[51:120]]
    docs = [(r.choice([None, *range(25)]), " ".join(r.choice(kinds)())) for _ in range(n)]
    return docs + [(3, None), (None, None), (7, ""), docs[0], docs[1], (99, "y " * 3000 + " ".join(base))]


@pytest.mark.parametrize("seed", [5, 6])
def test_substring_dedup(spark, seed):
    docs = messy(seed)
    assert plain(substring.deduplicate(frame(spark, docs))) == brute_windows(docs)


def test_substring_windows_choose_alike():
    r = random.Random(8)
    text = [r.choice("abcde") * r.randrange(1, 3) for _ in range(3000)] + ["z"] * 60
    memo = substring.WordHashes()
    codes = substring.hashed([w.encode() for w in text + text[200:900] + ["q"] + text[150:700]], memo)
    _, name, at, first, count, _, _ = substring.anchors(codes, np.array([len(codes)]), substring._Powers(), 20)
    seen = {}
    for n, a, f, c in zip(name, at, first, count, strict=True):
        for s in range(f, f + c):
            assert seen.setdefault(codes[s : s + 20].tobytes(), (n, a - s)) == (n, a - s)


def test_combiner_keeps_first_of_each_key():
    c = substring._Combiner(limit=4)
    u = lambda *x: np.array(x, np.uint64)
    i = lambda *x: np.array(x, np.int64)
    rows = [b for b in [*c.add(u(7, 7, 9, 7), u(1, 1, 1, 1), i(5, 2, 1, 2), i(0, 0, 0, 1), i(3, 8, 0, 8), i(1, 1, 1, 1)), *c.flush()]]
    got = [r for b in rows for r in b.to_pylist()]
    assert sorted((r["doc"], r["repeats"]) for r in got) == [(1, False), (2, False), (2, False), (5, True)]


MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts(spark):
    sp = tokencount.Counter.of(MODEL).sp
    r = random.Random(1)
    bits = [" ", "  ", "a", "b", "\n", "é", "th", "ing", "▁", "日本", " the", "</s>", "\t", "xxxxx", "😀", "\x00"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 60))) for _ in range(600)] + ["".join(r.choice(bits) for _ in range(900)) for _ in range(30)]
    texts += ["abcdé日" * 500, " " * 1000, "a " * 700, " a" * 600, "", " ", "  ", "a ", " a"]
    small = tokencount.Counter(MODEL, chunk=200, overlap=8, memo=50)
    for t in texts:
        assert small.count(t) == tokencount.Counter.of(MODEL).count(t) == len(sp.encode(t))
    docs = [(1, "hello world"), (1, "hello world"), (2, None), (None, "é" * 5000)]
    got = plain(tokencount.count_tokens(frame(spark, docs), MODEL, limit=3))
    assert got == sorted([(d, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 3) for d, t in docs], key=repr)
    assert tokencount.count_tokens(frame(spark, []), MODEL).count() == 0


def fingerprint(t):
    ws = (t or "").encode().lower().split()
    parts = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Sets(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        self[self.root(a)] = self.root(b)


def test_simhash(spark):
    r = random.Random(3)
    base = " ".join(r.choice("abcdef") + r.choice("gh") for _ in range(400))
    docs = [(r.choice([None, *range(40)]), r.choice([None, "", "a", "A b", "a b c É", "x " * r.randrange(9), " ".join(r.choice("abcdef") for _ in range(r.randrange(40))), base + f" w{r.randrange(30)}"])) for _ in range(250)]
    prints = [fingerprint(t) for _, t in docs]
    sets, distinct = Sets(), sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[i:]:
            if (a ^ b).bit_count() <= 3:
                sets.join(a, b)
    least = {}
    for (d, _), p in zip(docs, prints, strict=True):
        if d is not None:
            least[sets.root(p)] = min(least.get(sets.root(p), d), d)
    want = sorted([(d, f"{p:016x}", least.get(sets.root(p))) for (d, _), p in zip(docs, prints, strict=True)], key=repr)
    assert plain(simhash.near_duplicates(frame(spark, docs))) == want
    kept = simhash.keep_one(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "doc", "version"] and {r.doc_id for r in kept.collect()} == {c for d, _, c in want if d == c}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("home, visit", [(1 << 14, 1 << 16), (20, 30)])
def test_tiles_find_all_components(spark, home, visit):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(300)]
    prints = set(base)
    for b in base[:150]:
        for _ in range(6):
            x = b
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "print long")
    made = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, 3, home, visit).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in made)

    def classes(edges):
        s = Sets()
        for a, b in edges:
            s.join(a, b)
        out = collections.defaultdict(set)
        for p in prints:
            out[s.root(p)].add(p)
        return sorted(map(sorted, out.values()))

    assert classes(made) == classes((a, b) for i, a in enumerate(prints) for b in prints[i:] if (a ^ b).bit_count() <= 3)


def test_components(spark):
    r = random.Random(9)
    big = 1 << 62
    edges = [(big - i, big - i - 1) for i in range(60)] + [(r.randrange(-200, 0), r.randrange(-200, 0)) for _ in range(120)] + [(7, x) for x in range(100, 160)] + [(5, 5)]
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    groups = collections.defaultdict(list)
    for x in {x for e in edges if e[0] != e[1] for x in e}:
        groups[s.root(x)].append(x)
    want = sorted(((x, min(g)) for g in groups.values() for x in g), key=repr)
    assert plain(graph.components(spark.createDataFrame(edges, "a long, b long"))) == want


def levenshtein_ends(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return prev[1:]


def test_myers_matches_the_table():
    r = random.Random(2)
    for _ in range(200):
        p, t = ([r.choice("abc") for _ in range(r.randrange(1, n))] for n in (90, 60))
        assert decontam.myers(p, t) == levenshtein_ends(p, t)


def test_decontamination(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(5, 40)))) for i in range(12)] + [(90, "short one"), (91, None), (99, None)]
    items.append((50, items[0][1]))
    docs = []
    for i in range(150):
        ws = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            part = items[r.randrange(12)][1].upper().split()
            for _ in range(r.randrange(0, 6)):
                at = r.randrange(len(part))
                part[at : at + 1] = r.choice([[], ["new"], [part[at], "more"]]) or []
                part = part or ["left"]
            at = r.randrange(len(ws) + 1)
            ws[at:at] = [p + r.choice(["", "!!", ","]) for p in part]
        docs.append((i, " ".join(ws)))
    docs += [(None, items[1][1]), (3, None), (4, "")]
    want, fine = set(), []
    for d, t in docs:
        fine.append(t or "")
        for j, x in items[:12]:
            p = decontam.words(x)
            ends = levenshtein_ends(p, decontam.words(t))
            if ends and min(ends) <= int(len(p) * 0.2 + 1e-9):
                want.add((d, j, min(ends)))
                fine[-1] = None
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    for size in (2_000_000, 50):
        assert {(r.doc_id, r.item_id, r.distance) for r in decontam.contamination(df, bench, slice_words=size).collect()} == want
    left = decontam.clean(df, bench, slice_words=50)
    assert left.columns == df.columns and sorted(r.text or "" for r in left.collect()) == sorted(t for t in fine if t is not None)
    assert decontam.contamination(df, bench.limit(0)).count() == 0 and decontam.clean(df.limit(0), bench).count() == 0


def test_classifier_learns_and_reads_whole_texts(spark):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(60, 200))) + "."
    bad = lambda: good().upper().replace(" ", "!! ")
    docs = [(i, (good if i % 3 else bad)()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    df = frame(spark, [*docs, (500, None), (501, ""), (None, "a b"), (7, docs[7][1])])
    net = quality.fit(df, labels, sample=300)
    rows = quality.score(df, net).collect()
    assert len(rows) == 404 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in held]) > 0.95
    text = docs[1][1].encode() * 3
    changed = text[:-400] + docs[0][1].encode()[:400]
    assert net.predict([text])[0] != net.predict([changed])[0]
    assert np.allclose(net.predict([text, b"", changed]), [net.predict([x])[0] for x in (text, b"", changed)])
    kept = quality.keep_good(df, net)
    assert kept.columns == df.columns and kept.count() < 404
    for n in (0, 5, quality.CHUNK, quality.CHUNK + 1, 3000):
        s = quality.chunk_starts(n)
        assert s[0] == 0 and s[-1] + quality.CHUNK >= n and all(b - a == quality.STEP for a, b in zip(s, s[1:], strict=False))
    none = quality.fit(df, labels.limit(0))
    assert quality.score(df.limit(3), none).count() == 3
