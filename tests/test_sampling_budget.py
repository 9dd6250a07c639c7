import random

import pytest
from pyspark.sql import functions as F

from panelworks.functions import vocab
from panelworks.operators import budget, personas, sampling, weights


def seats(weights_, n):
    total = sum(weights_)
    exact = [w * n / total for w in weights_]
    out = [int(e) for e in exact]
    for j in sorted(range(len(out)), key=lambda j: -(exact[j] - out[j]))[: n - sum(out)]:
        out[j] += 1
    return out


def test_apportion_matches_plain_python(spark):
    r = random.Random(1)
    groups = [[float(r.randrange(1, 50)) for _ in range(r.randrange(1, 9))] for _ in range(40)] + [[0.0, 0.0], [1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(g, i, w) for g, ws in enumerate(groups) for i, w in enumerate(ws)], "g int, i int, w double")
    got = {}
    for x in sampling.apportion(df, ["g"], "w", F.lit(10), ["i"]).orderBy("g", "i").collect():
        got.setdefault(x.g, []).append(x.seats)
    assert all(got[g] == ([0, 0] if sum(ws) == 0 else seats(ws, 10)) for g, ws in enumerate(groups))
    assert got[41] == [4, 3, 3]


@pytest.mark.parametrize("n", [1000, 200])
def test_targets_sum_and_follow_margins(spark, n):
    cells = sampling.cell_targets(spark, n).collect()
    assert sum(c.target for c in cells) == n and len(cells) == 40
    total = sum(vocab.AGE_GENDER_COUNTS.values())
    for (a, g), count in vocab.AGE_GENDER_COUNTS.items():
        assert abs(sum(c.target for c in cells if (c.age_band, c.gender) == (a, g)) - n * count / total) <= 2.5


def pool(n, seed, old=0.25):
    r = random.Random(seed)
    out = []
    for i in range(n):
        band = "60+" if r.random() < old else r.choice(["18-29", "30-44", "45-59"])
        out.append((f"u{i}", r.choice(["Male", "Female", "Other"] if i % 50 == 0 else ["Male", "Female"]), band, r.choice(vocab.MODERATORS["race"]), "e", "i", "p"))
    return out


COLUMNS = "author string, gender string, age_band string, race string, education string, income string, party string"


def test_plentiful_and_scarce_pools(spark):
    agents, report, d = sampling.stratified_sample(spark.createDataFrame(pool(20000, 1), COLUMNS), n=200)
    # The report lists every cell with its target.
    assert report.count() == 40 and report.agg(F.sum("target"), F.sum("shortfall_before_redistribution")).first()[:] == (200, 0)
    assert agents.count() == 200 and d["unmet"] == 0 and d["excluded_other_gender"] > 0
    assert agents.where("gender = 'Other'").count() == 0 and agents.select("profile_id").distinct().count() == 200
    again, _, _ = sampling.stratified_sample(spark.createDataFrame(pool(20000, 1), COLUMNS).repartition(7), n=200)
    assert sorted(map(tuple, agents.select("profile_id", "author").collect())) == sorted(map(tuple, again.select("profile_id", "author").collect()))
    agents, report, d = sampling.stratified_sample(spark.createDataFrame(pool(500, 2, 0.05) + [("bad", "Male", "5", "Other", "", "", "")], COLUMNS), n=200)
    assert report.where("age_band = '60+' AND shortfall_before_redistribution > 0").count() > 0 and report.count() == 40 and d["dropped"] == 1
    assert agents.count() + d["unmet"] == 200


def test_budget_prefix_matches_a_loop(spark):
    r = random.Random(3)
    data = [(a, i, r.randrange(0, 4), r.randrange(1, 40)) for a in range(60) for i in range(r.randrange(1, 12))]
    df = spark.createDataFrame(data, "a int, seq int, ts int, cost int")
    got = {(x.a, x.seq) for x in budget.budget_prefix(df, ["a"], [F.desc("ts"), "seq"], "cost", 50).collect()}
    want = set()
    for a in range(60):
        used = 0
        for k, (_, s, _, c) in enumerate(sorted((x for x in data if x[0] == a), key=lambda x: (-x[2], x[1]))):
            if k and used + c > 50:
                break
            used += c
            want.add((a, s))
    assert got == want


def test_latest_best_and_resume(spark, rows):
    df = spark.createDataFrame([("p", "c", "partial", 1), ("p", "c", "complete", 2), ("q", "c", "complete", 3), ("q", "c", "failed", 4), ("q", "c", "complete", 5)], "pid string, cond string, status string, seq int")
    assert rows(budget.latest_best(df, ["pid", "cond"], budget.status_rank(), "seq"), "pid", "seq", "first_seen") == [("p", 2, 1), ("q", 5, 3)]
    assert rows(budget.not_done(df, df.where("pid = 'p'"), ["pid"]), "pid") == [("q",)] * 3


def test_weighted_shares(spark, rows):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 1.0), ("b", "x", 2.0)], "v string, w string, k double")
    assert rows(weights.weighted_marginals(df, ["v", "w"], "k")) == [("v", "a", 0.5), ("v", "b", 0.5), ("w", "x", 1.0)]
    assert rows(weights.weighted_crosstab(df, ["v", "w"], "k")) == [("a", "x", 1 / 3), ("b", "x", 2 / 3)]


POSTS = "author string, posts array<struct<type:string,subreddit:string,created_utc:string,title:string,body:string,score:string>>"


def test_verbalize(spark):
    posts = [("comment", "b", "1700000000", "", "hello there", ""), ("submission", "a", "1710000000.0", "Ti", "text", ""), ("comment", "a", "1705000000", "", "[deleted]", ""), ("comment", "a", "bad", None, "x" * 700, "")]
    t = personas.verbalize(spark.createDataFrame([("u", posts), ("none", [])], POSTS))
    u, none = (t.where(f"author = '{a}'").first() for a in ("u", "none"))
    lines = u.profile_text.split("\n")
    assert lines[0].endswith(": r/a (2), r/b (1)") and lines[1] == "Total posts and comments available: 3"
    assert lines[4] == '[1] 2024-03-09 | post in r/a | title: "Ti" | text: "text"' and lines[5] == '[2] 2023-11-14 | comment in r/b | text: "hello there"'
    assert lines[6].startswith("[3] bad | comment in r/a") and lines[6].endswith('..."') and (u.n_posts_included, u.n_posts_total) == (3, 4)
    assert none.profile_text.endswith("(no post or comment text available for this user)") and none.n_posts_included == 0
    tight = personas.verbalize(spark.createDataFrame([("u", posts)], POSTS), max_total_chars=10).first()
    assert tight.n_posts_included == 1


def test_personas_fall_back_and_resolve(spark):
    agents = spark.createDataFrame([("P1", "U", "Male", "18-29", "Other", vocab.MODERATORS["education"][0], vocab.MODERATORS["income"][0], "Other", "tx", "2001", "hi"), ("P2", "", "Female", "60+", "Other", vocab.MODERATORS["education"][0], vocab.MODERATORS["income"][0], "Other", "?", "2001", "")],
                                   "profile_id string, author string, gender string, age_band string, race string, education string, income string, party string, assigned_state string, year_birth string, note string")
    posts = spark.createDataFrame([("u", [("comment", "a", "1", "", "b", "")]), ("p2", [("comment", "a", "1", "", "b", "")])], POSTS)
    a, b = personas.build_personas(personas.check_agents(agents), posts).orderBy("profile_id").collect()
    assert (a.assigned_state, a.state_case, a.year_birth, a.n_posts_total, a.extra) == ("Texas", 1, 2001, 1, {"year_birth": "2001", "note": "hi"})
    assert (b.assigned_state, b.state_case, b.year_birth, b.n_posts_total) == (None, 4, 1958, 1)
    with pytest.raises(ValueError):
        personas.check_agents(agents.withColumn("party", F.lit("?")))


def test_persona_posts_name_the_parent(spark):
    inter = spark.createDataFrame([("Alice", "1", "s", "1", "mine ", "p" * 301), ("bob", "2", "s", "1", "mine", ""), ("eve", "3", "s", "1", "x", "")], "author string, id string, subreddit string, created_utc string, body string, parent_body string")
    agents = spark.createDataFrame([("alice",), ("Bob",), ("carol",)], "author string")
    p = personas.persona_posts(agents, inter)
    got = {r.author: r.posts[0].body for r in p.collect()}
    assert got == {"alice": "(Replying to another user's comment: \"" + "p" * 297 + "...\") mine", "bob": "mine"} and personas.without_posts(agents, p) == 1


def plain_redistribution(cells, max_rounds=10):
    """The rounds as a loop over (target, available): what each gets on top, and what stays unmet."""
    spare, had = [max(0, a - t) for t, a in cells], [0] * len(cells)
    need = sum(max(0, t - a) for t, a in cells)
    for _ in range(max_rounds):
        w = [t if s > h else 0 for (t, _), s, h in zip(cells, spare, had, strict=True)]
        if need <= 0 or not sum(w):
            break
        n = min(need, sum(spare) - sum(had))
        got = [n * x // sum(w) for x in w]
        for i in sorted((i for i, x in enumerate(w) if x), key=lambda i: -(n * w[i] % sum(w)))[: n - sum(got)]:
            got[i] += 1
        got = [min(g, s - h) for g, s, h in zip(got, spare, had, strict=True)]
        if not any(got):
            break
        had, need = [h + g for h, g in zip(had, got, strict=True)], need - sum(got)
    return had, max(0, need)


@pytest.mark.parametrize("at_once", [100_000, 5])
def test_redistribution_matches_a_loop(spark, monkeypatch, at_once):
    monkeypatch.setattr(sampling, "CELLS_AT_ONCE", at_once)
    r = random.Random(9)
    for n in (12, 40) if at_once > 5 else (30,):
        cells = [(r.randrange(0, 30), r.choice([0, 3, 10, 25, 200])) for _ in range(n)]
        df = spark.createDataFrame([(f"{i:03d}", t, a) for i, (t, a) in enumerate(cells)], "k string, target long, available long")
        got, unmet = sampling.redistribute_cells(df, ["k"])
        assert ([x.extra for x in got.orderBy("k").collect()], unmet) == plain_redistribution(cells)


def test_a_cell_with_most_rows_is_drawn_in_many_tasks(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 20 > 0, "big").when(F.col("id") % 40 == 0, None).otherwise("small").alias("c"))
    order = {(x.id, x.draw) for x in sampling.draw_order(df, ["c"], "id", 5).collect()}
    assert sorted(d for i, d in order if i % 20) == list(range(1, 19_001)) and sorted(d for i, d in order if i % 40 == 0) == list(range(1, 501))
    quota = spark.createDataFrame([("big", 7000), ("small", 3)], "c string, seats long")
    first = sampling.draw_first(df, ["c"], "id", 5, quota)
    assert {(x.id, x.draw) for x in first.collect()} == {(i, d) for i, d in order if i % 40 and d <= (7000 if i % 20 else 3)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = sampling.draw_first(df.where("id % 20 > 0"), ["c"], "id", 5, 7000).select("id", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranked) > 1 and max(x["count"] for x in ranked) < 0.6 * 7000
