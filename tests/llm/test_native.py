"""URL filters, mixing and sharding against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from panelworks.llm import mixing, queries, sharding, urlfilter

DOCS = "doc_id long, text string, lang string, source string, key string"


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("page_id", "page_id")
    return [tuple(r) for r in urlfilter.filter_urls(df, queries.URL_RULES + queries.URL_PATTERNS).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]


def test_url_rules(spark):
    got = judged(spark, ["https://A.Example.NET/en/x?y#z", "http://example.net/enx", "http://example.net", "x", None, "http://b.example.com/de/", "http://notexample.com/de/", "https://w.org/fr/", "http://my.cheap-pills.tk/", "http://org/FR/", "ftp://net/?q", "http://a.net#/x", "http://É.net/é"])
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/enx", "net/", "block"), ("example.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("b.example.com", "/de/", "example.com/de/", "block"), ("notexample.com", "/de/", None, "allow"), ("w.org", "/fr/", "org/fr/", "allow"), ("my.cheap-pills.tk", "/", None, "block"), ("org", "/FR/", None, "allow"),
        ("net", "/", "net/", "block"), ("a.net", "", None, "allow"), ("É.net", "/é", "net/", "block")]


def test_many_rules_by_brute_force(spark):
    r = random.Random(4)
    names = ["aa", "bb", "cc", "dd"]
    rules = list({(r.choice(["block", "allow"]), ".".join(r.choice(names) for _ in range(r.randrange(1, 3))) + "/" + "".join(r.choice(names) + "/" for _ in range(r.randrange(0, 2)))) for _ in range(30)})
    urls = [f"http://{'.'.join(r.choice(names) for _ in range(r.randrange(1, 5)))}/{'/'.join(r.choice(names) for _ in range(r.randrange(0, 3)))}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in urlfilter.filter_urls(df, [urlfilter.Rule(a, t) for a, t in rules]).collect()}
    for i, u in enumerate(urls):
        host, _, path = u.removeprefix("http://").partition("/")
        fit = [(len(t), a == "block", t, a) for a, t in rules if ("." + host).endswith("." + t.partition("/")[0]) and ("/" + path).startswith("/" + t.partition("/")[2])]
        best = max(fit, default=None)
        assert got[i] == ((best[2], best[3]) if best else (None, "allow"))


def test_patterns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://x.ads.com/track/1", "h"), (2, "http://x.com/badads", "h")], "page_id long, url string, host string")
    rules = [urlfilter.Rule("block", "||ads.com^", True), urlfilter.Rule("block", "/track/*", True)]
    assert [r.verdict for r in urlfilter.filter_urls(df, rules).orderBy("page_id").collect()] == ["block", "allow"]
    assert urlfilter.filter_urls(df.limit(0), rules).count() == 0


def corpus(n=300, seed=5):
    r = random.Random(seed)
    out = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(int(r.paretovariate(1.1)))), "en", r.choice(["a", "a", "a", "b", "c", None]), "k") for i in range(n)]
    return out + [(None, "x y", "en", "a", "k"), (n, None, "en", "b", "k"), (n + 1, "", "en", None, "k"), (3, "again here", "en", "a", "k"), (3, "again here", "en", "a", "k"), (n + 2, "only", "en", "zz", "k")]


def fill(sizes, weights, total, most):
    left, clamped = dict(sizes), {}
    while True:
        rest = total - sum(clamped.values())
        share = {s: rest * weights[s] / sum(weights[t] for t in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return clamped | share
        for s in over:
            clamped[s] = most * left.pop(s)
        if not left:
            return clamped


def test_mixing_meets_targets(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, DOCS)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(docs)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
    order = sorted((s for s in size if s is not None)) + [None]
    want = fill(dict(size), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), 2)
    for s in size:
        assert target[s] == (pytest.approx(want[s]), size[s]) and abs(taken[s] - want[s]) <= 2
    key = lambda rows: sorted(map(repr, rows))
    assert key(got) == key(mixing.mix_sources(df.repartition(5)).collect())
    copies = Counter(r.source for r in mixing.repeat_documents(df).collect())
    assert mixing.repeat_documents(df).columns == df.columns and set(copies) <= set(size)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_null_source_ties_with_another(spark):
    """Sources whose clamp / weight is equal, null among them, in every order of names."""
    for other in ("a", "b"):
        rows = [(1, "w " * 300, "en", other, "k"), (2, "w " * 100, "en", None, "k")]
        got = {r.source: (r.target, r.taken) for r in mixing.mix_sources(spark.createDataFrame(rows, DOCS), weights=(3, 1)).collect()}
        assert got == {other: (450.0, 450), None: (150.0, 150)}
    rows = [(i, "w " * n, "en", s, "k") for i, (n, s) in enumerate([(300, "a"), (100, "b"), (200, "c"), (300, None)])]
    got = {r.source: r.target for r in mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == pytest.approx(fill({"a": 300, "b": 100, "c": 200, None: 300}, {"a": 3, "b": 1, "c": 2, None: 3}, 1350, 2))


def test_mixing_keeps_columns_that_clash(spark):
    names = ["doc_id", "text", "lang", "source", "_key", "_source", "__times", "row", "plan_cut"]
    df = spark.createDataFrame([(i, "w " * (i + 1), "en", "ab"[i % 2], f"k{i}", "s", "t", "r", "c") for i in range(20)], names)
    made = mixing.repeat_documents(df)
    assert made.columns == names and {tuple(r) for r in made.collect()} <= {tuple(r) for r in df.collect()} and made.count() > 0
    assert mixing.mix_sources(df).count() == 20


def test_url_filter_keeps_columns_that_clash(spark):
    long = "http://a.net/" + "x/" * 40_000
    df = spark.createDataFrame([(1, "http://Ads.COM/x", "mine", 1), (1, "http://Ads.COM/x", "mine", 1), (2, long, "mine", 2), (None, None, None, None)], "page_id long, url string, _best string, __best int")
    got = urlfilter.filter_urls(df, [urlfilter.Rule("block", "ADS.com/"), urlfilter.Rule("block", "net/" + "x/" * 30_000)]).orderBy("page_id").collect()
    assert [(r.page_id, r._best, r.verdict, r["__best"]) for r in got] == [(None, None, "allow", None), (1, "mine", "block", 1), (1, "mine", "block", 1), (2, "mine", "block", 2)]
    with pytest.raises(ValueError):
        urlfilter.filter_urls(df, [urlfilter.Rule("block", f"h{i}/") for i in range(3)], max_rules=2)


def test_mixing_cuts_inside_one_bin(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    a, b = (Counter() for _ in range(2))
    for n, out in ((1, a), (1 << 14, b)):
        for r in mixing.mix_sources(df, bins=n).collect():
            out[r.source] += r.taken
    assert all(abs(a[s] - b[s]) <= 2 for s in a)


def brute_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        shards, load = 1, 0
        for s in sizes:
            if load + s > mid:
                shards, load = shards + 1, 0
            load += s
        low, high = (low, mid) if shards <= k else (mid + 1, high)
    return high


@pytest.mark.parametrize("n, k, bits", [(1, 3, 1), (40, 3, 2), (900, 10, 3), (700, 40, 4)])
def test_minimax_is_smallest(spark, n, k, bits):
    r = random.Random(n)
    groups = sorted((r.getrandbits(64) - (1 << 63), int(r.paretovariate(1.1) * 20)) for _ in range(n))
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "key long, size long"), k, first_bits=bits, step_bits=2)
    loads = Counter()
    for key, size in groups:
        loads[sum(key >= c for c in cuts)] += size
    assert capacity == brute_capacity([s for _, s in groups], k) and max(loads.values()) <= capacity and len(loads) <= k


def test_shards(spark):
    docs = corpus() + [(1000 + i, "copies", "en", "a", "k") for i in range(50)]
    got = sharding.shard(spark.createDataFrame(docs, DOCS), shards=7, salts=5).collect()
    assert len(got) == len(docs)
    slots, where = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert where.setdefault(r.key, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(7))
    text = {d: t for d, t, *_ in docs}
    for r in got:
        if r.doc_id not in (3, None):
            t = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(t) + 16, zlib.crc32(t))
    assert len({r.shard for r in got if r.doc_id and r.doc_id >= 1000}) == 1
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
