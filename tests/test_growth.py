"""Expressions that are made once for a row, and values that only larger tables have."""

from pyspark.sql import functions as F

from panelworks.functions import answers as A
from panelworks.functions import recode as R
from panelworks.functions import text as X
from panelworks.functions import vocab
from panelworks.operators import survey, tiers, validate
from panelworks.sources import readers, recordlog


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_id_is_made_once_for_its_check(spark):
    ids = ["0000-0002-1825-0097", "0000-0002-1825-0096", "0000-0002-9079-593X", "0000-0002-9079-593x", "0000000218250097", "0000-0002-1825-0097\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "i int, t string").repartition(1)
    got = df.select("i", R.orcid_ok(F.reverse(F.reverse("t"))).alias("ok"))
    assert [r.ok for r in got.orderBy("i").collect()] == [True, False, True, False, False, False, False]
    assert plan(got).count("reverse(reverse(") == 1


def test_dates_after_the_year_9999(spark):
    said = [("1700000000", "2023-11-14"), ("253402300799", "9999-12-31"), ("253402300800", "10000-01-01"), ("779300000000", "26665-01-12"), ("1700000000000000", "1700000000"), ("soon", "soon"), (None, "unknown date")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string")
    assert [r.d for r in df.orderBy("i").select(X.day("t").alias("d")).collect()] == [d for _, d in said]


def test_records_finished_together_are_synced_once(tmp_path, monkeypatch):
    synced = []
    monkeypatch.setattr(recordlog.os, "fsync", lambda fd: synced.append(fd))
    segment = recordlog.Segment(str(tmp_path), "a.jsonl")
    segment.extend([{"k": i} for i in range(1000)])
    segment.append({"k": 1000})
    segment.extend([])
    segment.close()
    assert len(synced) == 2 and [r["k"] for r in recordlog.whole_records((tmp_path / "a.jsonl").read_bytes())] == list(range(1001))


def test_records_leave_a_task_together():
    tables = list(survey._batches(iter([{"a": i, "b": {"x": [i]}} for i in range(300)]), ["a", "b", "c"]))
    assert len(tables) == 3 and [r for t in tables for r in t.to_dict("records")] == [{"a": i, "b": {"x": [i]}, "c": None} for i in range(300)]


def test_effects_make_means_once(spark):
    df = spark.createDataFrame([("control", 10.0), ("control", 20.0), ("Funding", 40.0), ("Funding", None)], "condition string, trust_post double")
    got = tiers.effects(tiers.condition_means(df, "condition", ["trust_post"]), "condition", "control")
    assert [tuple(r) for r in got.collect()] == [("Funding", "trust_post", 25.0)]
    assert "Join" not in plan(got)


def people(spark, n):
    agents = readers.synthetic_agents(spark, n)
    return agents.select("profile_id", F.struct(*vocab.MODERATORS).alias("demographics"), "assigned_state", F.lit(1).alias("state_case"), "year_birth", F.lit("text").alias("profile_text"))


def test_a_survey_reads_its_agents_once(spark, tmp_path):
    people(spark, 3).write.parquet(str(tmp_path / "p"))
    some = spark.read.parquet(str(tmp_path / "p"))
    o = survey.RunOptions(conditions=["control", "Funding"])
    whole = survey.run_survey(some, survey.DummyClient, o)
    assert plan(whole).count("parquet") == 1 and "Aggregate" not in plan(whole)
    few = survey.run_survey(some, survey.DummyClient, o, columns=["condition", "profile_id", "answers"])
    assert few.columns == ["condition", "profile_id", "answers"]
    key = lambda df: sorted((r.profile_id, r.condition, sorted(r.answers.items())) for r in df.collect())
    assert key(few) == key(whole) and len(key(few)) == 6


def test_a_client_that_waits_for_nothing_needs_no_threads():
    import threading

    class Waits(survey.DummyClient):
        def chat(self, *a):
            return survey.DummyClient.chat(self, *a)

    marked = lambda client: getattr(client.chat, "at_once", False)
    assert marked(survey.DummyClient()) and marked(survey.FixedClient("x")) and not marked(Waits())
    assert set(survey.in_flight(iter(range(3)), lambda _: threading.current_thread(), 1)) == {threading.current_thread()}


def test_answers_in_form_are_not_read_line_by_line(monkeypatch):
    keys = ["trust_post_1", "donation", "newsletter"]
    block = "**title: {}**\n**explanation: {}**\n**answer: {}**\n**speculation: {}**"
    texts = ["\n\n".join([block.format("TRUST_POST", " so  it is", "72 ", 30), block.format("DONATION", "", "Don3", "x"), block.format("NEWSLETTER", "word " * 900, "maybe", 101), block.format("TRUST_POST", "", 7, 7)]), ""]
    fast = [A.parse_answers(t, keys) for t in texts]
    for odd in (block.format("TRUST_POST", "a: b", 1, 2), block.format("TRUST_POST", "", "", 2), "so " + texts[0], texts[0] + "."):
        assert A._in_form(odd) is None
    monkeypatch.setattr(A, "_in_form", lambda t: None)
    assert [A.parse_answers(t, keys) for t in texts] == fast and fast[0]["items"]["trust_post_1"]["answer"] == "7"


def test_reports_are_made_by_all_tasks(spark):
    """Deposits of a table that one task reads."""
    df = spark.range(40).select("id", F.when(F.col("id") < 39, '{"team_id": "t"}').alias("metadata"), F.create_map(F.lit("a.csv"), F.lit("ab")).alias("files")).coalesce(1)
    told = validate.metadata_reports(df)
    got = told.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1 and {r.detail for r in got if r.id == 39} == {"not one"}
    assert [(r.check, r.status, r.detail) for r in got if r.id == 3] == validate.validate_metadata({"team_id": "t"}).rows
    forms = spark.createDataFrame([(i, "- **1 L** - p:\n" if i % 2 else None) for i in range(20)], "i int, form string").coalesce(1)
    counted = validate.blank_answer_counts(forms).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in counted}) > 1 and all(r.blank == r.i % 2 for r in counted)


def test_what_is_sorted_is_made_once(spark):
    answers = F.create_map(*[x for k in vocab.ITEM_KEYS for x in (F.lit(k), F.lit("50" if k not in vocab.CHOICES else vocab.CHOICES[k][0][0]))])
    demo = F.struct(*[F.lit(v[0]).alias(m) for m, v in vocab.MODERATORS.items()])
    r = spark.range(6).select(F.format_string("p%d", 5 - F.col("id")).alias("profile_id"), F.lit("control").alias("condition"), F.lit("control dances").alias("codename"), answers.alias("answers"), demo.alias("demographics"),
                              F.lit(1990).alias("year_birth"), F.lit(0).alias("first_seen"))
    t1 = tiers.tier1(tiers.raw_export(r))
    assert [x.profile_id for x in t1.collect()] == [f"p{i}" for i in range(6)] and t1.columns == tiers.TIER1
    assert "parquet" in plan(t1) and "regexp_replace" not in plan(t1) and "Join" not in plan(t1)


def test_answers_in_form_are_judged_by_what_was_judged_before(monkeypatch):
    keys = ["trust_post_1", "donation"]
    text = "**title: TRUST_POST**\n**explanation: so.**\n**answer: {}**\n**speculation: 30**\n\n**title: DONATION**\n**explanation: so.**\n**answer: Don3**\n**speculation: 300**"
    want = {n: A.parse_answers(text.format(n), keys) for n in (71, 101)}
    assert want[71]["items"]["trust_post_1"] == {"answer": "71", "speculation": 30, "explanation": "so.", "ok": True} and want[101]["invalid"] == ["trust_post_1"]
    for name in ("_judged", "_answer", "_key_of", "whole_number"):
        monkeypatch.setattr(A, name, None)
    assert {n: A.parse_answers(text.format(n), keys) for n in want} == want


def test_prompts_are_hashed_where_calls_are_kept():
    person = {"profile_id": "p", "demographics": {m: v[0] for m, v in vocab.MODERATORS.items()}, "profile_text": "text"}
    for hashed in (True, False):
        asker = survey.Asker(survey.DummyClient(), person, "control", survey.RunOptions(), hashed=hashed)
        parse = asker.step(0, "battery", ["p:x", "i:trust_post_1"], ["trust_post_1"], [], [], {})
        assert parse["items"]["trust_post_1"]["ok"] and bool(asker.calls[0]["prompt_sha256"]) is hashed


def test_what_is_exported_is_narrow_before_the_best_is_picked(spark):
    answers = F.create_map(*[x for k in vocab.ITEM_KEYS for x in (F.lit(k), F.lit("50" if k not in vocab.CHOICES else vocab.CHOICES[k][1][0]))])
    demo = F.create_map(*[x for m, v in vocab.MODERATORS.items() for x in (F.lit(m), F.lit(v[-1]))])
    r = spark.range(8).select(F.format_string("p%d", F.col("id") % 4).alias("profile_id"), F.lit("Funding").alias("condition"), F.lit("phony parrotfish").alias("codename"), answers.alias("answers"), demo.alias("demographics"),
                              F.when(F.col("id") != 1, 1990).alias("year_birth"), F.col("id").alias("seconds"), F.lit("complete").alias("status"), (F.col("id") % 5).alias("seq"))
    narrow = tiers.with_export(r)
    assert "map<" not in narrow.schema.simpleString()
    best = tiers.usable_responses(narrow)
    assert [sorted(map(tuple, tiers.raw_export(x).collect()), key=repr) for x in (best, tiers.usable_responses(r))] == 2 * [sorted(map(tuple, tiers.raw_export(best).collect()), key=repr)]
    got = {x.profile_id: x for x in tiers.raw_export(best).collect()}
    assert list(tiers.raw_export(best).columns) == tiers.RAW and len(got) == 4
    assert (got["p0"]["Duration (in seconds)"], got["p1"]["Duration (in seconds)"], got["p1"].donation, got["p1"].newsletter, got["p3"].year_birth) == (4, 1, 1, 2, 1990)
    assert got["p1"].year_birth == vocab.SURVEY_YEAR - vocab.BAND_AGE["60+"] and sorted(x.ResponseId for x in got.values()) == [f"R_run_{i:06d}" for i in range(4)]
