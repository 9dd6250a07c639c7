from pyspark.sql import functions as F

from panelworks.operators import activity, history, interactions, threads
from panelworks.sources import readers


def test_history_aligns_and_dedups(spark, rows):
    subs = spark.createDataFrame([("User_A", "s1", "1", "x", "t", "ti"), ("user_a", "s2", "1", "x", "t", "ti"), ("User_B", "s3", "1", "x", "t", "ti")], "author_key string, ID string, created_utc string, subreddit string, text string, title string")
    coms = spark.createDataFrame([("User_A", "c1", "b", "t3_s1")], "author_key string, id string, body string, parent_id string")
    h = history.build_history([subs], [coms])
    assert h.columns == history.COLUMNS
    assert rows(h, "author", "id", "post_type") == [("user_a", "c1", "comment"), ("user_a", "s1", "submission"), ("user_a", "s2", "submission"), ("user_b", "s3", "submission")]
    assert {r.body for r in h.collect()} == {"t", "b"} and {r.link_id for r in h.collect()} == {""}
    again = history.build_history([subs, subs.limit(1).withColumn("ID", F.lit("s4"))], [coms])
    assert again.count() == 5
    no_ids = subs.drop("ID")
    assert history.build_history([no_ids], []).count() == 3  # a blank id identifies nothing
    assert rows(history.inference_pool(spark.createDataFrame([("submission", ""), ("comment", "t3_s1"), ("comment", "t1_c1"), ("comment", None)], "post_type string, parent_id string"))) == [("comment", "t3_s1"), ("submission", "")]


def test_counts_states_and_backfill(spark, rows):
    h = spark.createDataFrame([("User_A", "Alaska"), ("user_a", "alaska"), ("user_a", "personalfinance"), ("User_B", "Alaska"), ("", "spam")], "author string, subreddit string")
    c = activity.activity_counts(h)
    assert rows(c) == [("user_a", "alaska", 2), ("user_a", "personalfinance", 1), ("user_b", "alaska", 1)]
    assert rows(activity.explode_map(activity.activity_map(c))) == rows(c)
    states = spark.createDataFrame([("texas", "r/Texas"), ("texas", "r/houston"), ("california", "r/California"), ("a", "both"), ("b", "both")], "state string, subreddit string")
    t = spark.createDataFrame([("user_a", "texas", 3), ("user_a", "houston", 2), ("user_a", "california", 4), ("user_b", "askreddit", 100), ("user_b", "both", 9), ("user_c", "texas", 5), ("user_c", "california", 5)], "author string, subreddit string, total int")
    s = activity.assign_state(t, states)
    assert rows(s) == [("user_a", "texas", 5, 2, False), ("user_c", "california", 5, 2, True)]
    agents = spark.createDataFrame([("1", "user_a", ""), ("2", "user_b", ""), ("3", "user_d", "Nevada")], "profile_id string, author string, assigned_state string")
    assert rows(activity.backfill(agents, s, "author", "assigned_state"), "author", "assigned_state") == [("user_a", "texas"), ("user_b", ""), ("user_d", "Nevada")]


def test_weighted_scores_skip_missing(spark, rows):
    c = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 9), ("b", "q", 2)], "author string, g string, total int")
    s = spark.createDataFrame([("x", 1.0, 2.0), ("y", 0.0, float("nan"))], "g string, p double, q double")
    assert rows(activity.weighted_scores(c, s, "g", "author", "total", ["p", "q"])) == [("a", 0.25, 2.0, 3, 2), ("b", None, None, 1, 0)]


THREAD = "post_type string, id string, author string, created_utc string, body string, parent_id string"


def test_thread_structure(spark, rows):
    h = spark.createDataFrame([
        ("submission", "sub1", "A", "1", "s", ""), ("comment", "c1", "A", "2", "First take on this.", "t3_sub1"), ("comment", "r1", "B", "3", "r", "t1_c1"), ("comment", "r2", "A", "4", "r", "t1_r1"),
        ("comment", "r3", "B", "5", "r", "t1_ext1"), ("comment", "r4", "A", "6", "r", "t1_ghost")], THREAD)
    first = threads.classify(h)
    kinds = {r.id: r.structure_kind for r in first.collect()}
    assert kinds == {"sub1": "submission", "c1": "first_level_comment", "r1": "reply_depth2", "r2": "reply_deeper", "r3": "unresolved", "r4": "unresolved"}
    assert rows(first.where("id = 'r1'"), "parent_body") == [("First take on this.",)]
    assert rows(threads.missing_parents(first)) == [("ext1",), ("ghost",)]
    ext = spark.createDataFrame([("comment", "ext1", "outsider", "1", "x", "t3_sub1")], THREAD)
    second = threads.classify(h, ext)
    assert rows(second.where("id = 'r3'"), "structure_kind", "parent_author") == [("reply_depth2", "outsider")]
    assert rows(threads.missing_parents(second)) == [("ghost",)]
    scoped = threads.classify(h, authors=spark.createDataFrame([("b",)], "author string"))
    assert rows(scoped, "id", "structure_kind") == [("r1", "reply_depth2"), ("r3", "unresolved")]


def _reply(i, body, parent="Some parent text here", author="a", kind="reply_depth2", parent_id="t1_p"):
    return (kind, author, i, "s", "1", body, "p", parent, parent_id)


def test_meaningful_interactions(spark, rows):
    long = "word " * 9
    d = spark.createDataFrame([
        _reply("short", "but no"), _reply("cue", long + "However, you are here"), _reply("plain", "word " * 12), _reply("quoted", long + "\n> a line"),
        _reply("echo", "he said the quick brown fox jumps over and out again today", "The quick, brown fox jumps!"), _reply("relaxed", "tiny reply", author="E"), _reply("zero", "x", author="f"), _reply("other", long + "you", kind="first_level_comment"),
        _reply("wait", long + "why though", kind="unresolved", parent_id="t1_ext1")], "structure_kind string, author string, id string, subreddit string, created_utc string, body string, parent_author string, parent_body string, parent_id string")
    got = {r.id: r.matched_cues for r in interactions.meaningful(d).collect()}
    assert got == {"cue": "second_person;disagreement", "quoted": "quotes_parent;quotation", "echo": "quotation"} or got == {"cue": "second_person;disagreement", "quoted": "quotes_parent;quotation", "echo": "quotation", **{}}
    loose = interactions.meaningful(d, spark.createDataFrame([("e", "2"), ("F", "0")], "author string, min_words string"))
    extra = {r.id: r.matched_cues for r in loose.collect() if r.id not in got}
    assert extra == {"relaxed": "relaxed_min_words:2", "zero": "relaxed_min_words:0"}
    assert rows(interactions.pending_fetch(d), "reply_id", "parent_bare_id") == [("wait", "ext1")]
    agents = spark.createDataFrame([("Alice",), ("bob",), ("carol",)], "author string")
    covered = interactions.coverage(agents, spark.createDataFrame([("alice",), ("ALICE",), ("bob",)], "author string"))
    assert rows(covered) == [("Alice", 2), ("bob", 1), ("carol", 0)]
    assert interactions.coverage_stats(covered).first().below_1 == 1


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, rows, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,body,n\n1,"two\nlines, ""quoted""",\n2,back\\slash,007\n')
    assert rows(readers.read_csv(spark, str(p))) == [("1", 'two\nlines, "quoted"', ""), ("2", "back\\slash", "007")]
    j = tmp_path / "a.jsonl"
    j.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(readers.read_jsonl(spark, str(j), "a int")) == [(1,), (2,)]
    raw = spark.createDataFrame([(0, "Start"), (1, '{"ImportId":"x"}'), (2, "v")], "seq int, a string")
    assert rows(readers.strip_export_header(raw)) == [(2, "v")]


def test_stata_source(spark, tmp_path):
    import pandas as pd

    from panelworks.sources import external

    p = tmp_path / "c.dta"
    pd.DataFrame({"pid3": [1.0, 2.0, None], "commonweight": [0.5, 1.5, 1.0]}).to_stata(p, write_index=False)
    external.register(spark)
    got = spark.read.format("stata").option("path", str(p)).option("columns", "pid3,commonweight").load().collect()
    assert [(r.pid3, r.commonweight) for r in got] == [(1.0, 0.5), (2.0, 1.5), (None, 1.0)]


def test_census_source_reads_every_state_or_fails(spark, tmp_path):
    import pytest

    from panelworks.sources import external

    external.register(spark)
    for s in ("01", "02"):
        (tmp_path / f"{s}.json").write_text(f'[["AGEP","SEX","state"],["30","1","{s}"],["40","2","{s}"]]')
    load = lambda states: spark.read.format("census").option("url", f"file://{tmp_path}/{{state}}.json").option("columns", "AGEP,state").option("states", states).load()
    assert load("1,2").count() == 4
    with pytest.raises(Exception):
        load("1,2,4").count()
