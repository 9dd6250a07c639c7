"""What must hold beyond a few thousand rows: ids, numbers, plans without a single task."""

from pyspark.sql import functions as F

from panelworks.functions import text as X
from panelworks.functions import vocab
from panelworks.operators import history, interactions, order, sampling, threads, tiers


def test_ids_of_many_agents(spark):
    pick = lambda m: F.element_at(F.array(*[F.lit(x) for x in vocab.MODERATORS[m]]), (F.pmod(F.xxhash64(F.lit(m), "id"), F.lit(len(vocab.MODERATORS[m]))) + 1).cast("int")).alias(m)
    pool = spark.range(200_000).select(F.format_string("a%d", "id").alias("author"), *[pick(m) for m in vocab.MODERATORS])
    agents, report, told = sampling.stratified_sample(pool, n=10_001)
    assert set(sampling.AGENT_COLUMNS) <= set(agents.columns)
    got = agents.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("profile_id").alias("ids"), F.count_distinct("author").alias("authors"), F.max(F.length("profile_id")).alias("longest"), F.sum("sampling_weight").alias("w"),
                     F.count_if(F.col("quota_cell_id") != F.concat_ws("|", "gender", "age_band", "race")).alias("odd")).first()
    assert (got.n, got.ids, got.authors, got.longest, got.w, got.odd) == (10_001, 10_001, 10_001, 11, 10_001.0, 0) and told["unmet"] == 0
    assert report.count() == 40 and report.agg(F.sum("target")).first()[0] == 10_001


def test_numbers_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("_kept"))
    got = order.numbered(df.repartition(7), ["k"], "place", 1)
    assert got.columns == ["k", "_kept", "place"] and got.where("place <> k + 1").count() == 0 and got.count() == 5000
    assert order.numbered(df.limit(0), ["k"], "place").count() == 0


def test_response_ids_of_many_responses(spark):
    answers = F.create_map(*[x for k in vocab.ITEM_KEYS for x in (F.lit(k), F.lit("50" if k not in vocab.CHOICES else vocab.CHOICES[k][0][0]))])
    demo = F.struct(*[F.lit(v[0]).alias(m) for m, v in vocab.MODERATORS.items()])
    r = spark.range(30).select(F.format_string("p%02d", "id").alias("profile_id"), F.lit("control").alias("condition"), F.lit("control dances").alias("codename"), answers.alias("answers"), demo.alias("demographics"),
                               F.lit(1990).alias("year_birth"), (100 - F.col("id")).alias("first_seen"), F.lit(12.4).alias("seconds"))
    raw = tiers.raw_export(r, "a%b")
    ids = {x.profile_id: (x.ResponseId, x["Duration (in seconds)"]) for x in raw.collect()}
    assert ids["p29"] == ("R_a%b_000000", 12) and ids["p00"] == ("R_a%b_000029", 12)
    assert "SinglePartition" not in raw.select("profile_id", "ResponseId")._jdf.queryExecution().executedPlan().toString().split("_before")[0].split("InMemory")[0]


def test_first_of_hot_keys_is_an_aggregate(spark):
    df = spark.createDataFrame([("h", 3, "c"), ("h", 1, "a"), ("", 1, "x"), ("", 1, "y"), (None, 5, "z"), ("k", 2, None)], "id string, seq int, v string")
    got = history.dedup_first(df, "id", ["seq"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("h", 1, "a"), ("", 1, "x"), ("", 1, "y"), (None, 5, "z"), ("k", 2, None)], key=repr)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_replies_are_joined(spark):
    rows = [("submission", "s", "a", "1", "hi", ""), ("comment", "c1", "b", "2", "one", "t3_s"), ("comment", "c2", "a", "3", "two", "t1_c1"), ("comment", "c3", "b", "4", "three", "t1_c2"), ("comment", "c4", "b", "5", "four", "t1_zz"), ("comment", "c5", "b", "6", "five", None)]
    df = spark.createDataFrame(rows, "post_type string, id string, author string, created_utc string, body string, parent_id string")
    got = threads.classify(df)
    assert {(r.id, r.structure_kind, r.parent_body) for r in got.collect()} == {
        ("s", "submission", ""), ("c1", "first_level_comment", ""), ("c2", "reply_depth2", "one"), ("c3", "reply_deeper", "two"), ("c4", "unresolved", ""), ("c5", "unresolved", "")}
    assert [r.id for r in threads.missing_parents(got).collect()] == ["zz"]


def test_cues_and_quotations_fold_case(spark):
    said = [("I THINK it is wrong", ["disagreement", "hedge"]), ("what ıf? TIL", ["question", "concession"]), ("ſure, obviouſly", ["booster"]), ("> said", ["quotes_parent"]), ("touché", ["concession"]), (None, [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string")
    assert [r.c for r in df.orderBy("i").select(X.cues("t").alias("c")).collect()] == [w for _, w in said]
    pairs = [("well the cat sat on the matter", "Cat sat on the mat", True), ("cat sat on the", "cat sat on the mat", False), ("xcat sat on the mat", "cat sat on the mat", True), ("sat on the", "a b", False), (None, None, False), (" > so", "", True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.q for r in df.orderBy("i").select(X.quotes("a", "b").alias("q")).collect()] == [w for *_, w in pairs]


def test_histogram_of_coverage(spark):
    df = spark.createDataFrame([(n,) for n in (0, 0, 3, 20, 21, 400)], "n_posts int")
    assert {tuple(r) for r in interactions.coverage_histogram(df).collect()} == {(0, 2), (3, 1), (20, 1), (None, 2)}
