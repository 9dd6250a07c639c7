import json
import math

import pytest
from pyspark.sql import functions as F

from panelworks.functions import answers as A
from panelworks.functions import recode as R
from panelworks.functions import text as X
from panelworks.functions import vocab
from panelworks.operators import redact, session, survey, tiers, validate
from panelworks.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_spans_and_guesses():
    assert A.json_spans('a } {"a": {"b": 1}} x {} {') == ['{"a": {"b": 1}}', "{}"]
    levels = {"party": ["Democrat", "Other"]}
    good = '{"party": {"top_guess": "Other", "alternates": ["Democrat"], "confidence": 70}}'
    assert A.last_valid_guess("so: {\"party\": 1} " + good + " {oops}", levels) == json.loads(good)
    assert A.last_valid_guess(good.replace("70", "101"), levels) is None and A.last_valid_guess(None, levels) is None


@pytest.mark.parametrize("said, want", [("72/100", 72), ("about 72", 72), ("72.5", 72), ("73.5", 74), ("150", None), ("-3", None), ("none", None), ("1,00", 100)])
def test_whole_number(said, want):
    assert A.whole_number(said) == want


@pytest.mark.parametrize("said, want", [("Don3", "Don3"), ("don10)", "Don10"), ("$10", "Don10"), ("$1", "Don1"), ("I give 4 dollars", "Don4"), ("eleven", None)])
def test_donation_choice(said, want):
    assert A.choice(said, vocab.CHOICES["donation"]) == want


@pytest.mark.parametrize("said, want", [("Yes", "News1"), ("News2", "News2"), ("I did not", "News2"), ("subscribed", "News1"), ("maybe", None)])
def test_yes_no_choice(said, want):
    assert A.choice(said, vocab.CHOICES["newsletter"]) == want


def test_answer_blocks_last_valid_wins():
    text = "thinking\n**title: TRUST_POST**\n**answer: 10**\n\n**title: trust_post (again)**\n**explanation: because\nof it**\n**answer: 72/100**\n**speculation: 40**\n\n**title: TRUST_POST**\n**answer: no idea**\n\ntitle: DONATION_1\nsymbol: Don3\n"
    p = A.parse_answers(text, ["trust_post_1", "donation", "newsletter"])
    assert p["items"]["trust_post_1"] == {"answer": "72", "speculation": 40, "explanation": "because of it", "ok": True}
    assert p["items"]["donation"]["answer"] == "Don3" and p["missing"] == ["newsletter"] and p["duplicated"] == ["trust_post_1"] and p["invalid"] == []
    assert A.export_value("donation", "Don3") == 3 and A.export_value("newsletter", "News2") == 2 and A.export_value("trust_post_1", "72") == 72
    assert len({vocab.title(k) for k in vocab.ITEM_KEYS}) == 44


def test_answer_lines_in_many_shapes():
    keys = ["trust_post_1", "donation", "newsletter"]
    shapes = {
        "title: TRUST_POST\nanswer: 72%": "72", "  **Title： trust_post:**\n**Selected answer:** **72.0**": "72", "**title: TRUST_POST**\n**answer:**\n72": "72",
        "**title: TRUST_POST_1 (now)**\nMy final response: about 72": "72", "**title: TRUST_POST**\n**explanation: the value is plain\nto see\n**answer: 72**": "72",
        "**title: TRUST_POST**\n**answer: 150**": None, "**title: TRUST_POST**": None, "**title: TRUST_POST**\r\n**answer: 1,00**\r\n": "100",
    }
    for text, want in shapes.items():
        assert A.parse_answers(text, keys)["items"]["trust_post_1"]["answer"] == want, text
    p = A.parse_answers("**title: DONATION_1**\n**category: $10**\n**title: SUBSCRIPTION\n**title: NOTHING**\n**answer: 5**", keys)
    assert p["items"]["donation"]["answer"] == "Don10" and "trust_post_1" in p["missing"]
    long = A.parse_answers("**title: TRUST_POST**\n**explanation: " + "word " * 900 + "**\n**answer: 1**", keys)
    assert len(long["items"]["trust_post_1"]["explanation"]) == 2000 and A.parse_answers(None, keys)["missing"] == keys
    twice = A.parse_answers("**title: TRUST_POST**\n**answer: 5**\n**title: TRUST_POST**\n**answer: none**\n**title: TRUST_POST**\n**answer: ?**", keys)
    assert twice["items"]["trust_post_1"]["answer"] == "5" and twice["duplicated"] == ["trust_post_1"] and twice["invalid"] == []


def stream(*positions):
    out = []
    for token, *rest in positions:
        out.append({"token": token, "logprob": 0.0, "top_logprobs": [{"token": t, "logprob": math.log(p)} for t, p in rest]})
    return out


def test_pmf_of_digits():
    text = "**title: TRUST_POST**\n**answer: 72**"
    s = stream(("**title: TRUST_POST**\n**answer: ",), ("7", ("7", 0.8), ("1", 0.1), ("７", 0.1)), ("2", ("2", 0.5), ("0", 0.25), ("**", 0.25)), ("**", ("**", 1.0)))
    d = A.answer_dists(text, s, ["trust_post_1"])["trust_post_1"]
    assert d["mode"] == 72 and d["pmf"][72] == pytest.approx(8 / 9 / 2) and d["pmf"][7] == pytest.approx(8 / 9 / 4) and sum(d["pmf"].values()) == pytest.approx(1) and d["borrowed"] == pytest.approx(1 / 9)
    hundred = A.answer_pmf([A.digit_row(x) for x in ({"1": 1.0}, {"0": 1.0}, {"0": 0.75, "**": 0.25})], 100)
    assert hundred["pmf"] == pytest.approx({100: 0.75, 10: 0.25})
    assert A.answer_pmf([A.digit_row({"0": 1.0}), A.digit_row({"**": 1.0})], 0)["pmf"] == {0: 1.0}
    assert A.answer_dists("other text", s, ["trust_post_1"]) == {}
    assert A.compact(d, 1)["top"] == {"72": 0.4444}


@pytest.mark.parametrize("said, want", [("1985", 1985), ("born in 1985, moved 1990", 1985), ("1985 or 1990", 1990), ("35", 1991), ("1985.", 1985), ("17", None), ("", None)])
def test_birth_year(spark, said, want):
    assert one(spark, R.birth_year(F.lit(said))) == want


def test_scalars(spark):
    assert [one(spark, R.age_band(F.lit(a))) for a in (17, 18, 29, 30, 45, 60)] == [None, "18-29", "18-29", "30-44", "45-59", "60+"]
    assert [one(spark, R.binary(F.lit(x))) for x in ("1", "2", "yes", "1.0", "No", "x")] == [1, 0, 1, 1, 0, None]
    assert one(spark, R.decode(F.lit("3"), vocab.MODERATORS["race"])) == "Hispanic / Latino"
    with pytest.raises(Exception, match="unknown level"):
        one(spark, R.decode(F.lit("nine"), vocab.MODERATORS["race"]))
    assert one(spark, R.condition(F.lit(" crushing chicken;  gross grasshopper; homely halibut"))) == "High public trust"
    assert one(spark, R.orcid_ok(F.lit("0000-0002-1825-0097"))) and not one(spark, R.orcid_ok(F.lit("0000-0002-1825-0096"))) and not one(spark, R.orcid_ok(F.lit("https://orcid.org/0000-0002-1825-0097")))
    assert one(spark, R.half_even(F.lit(2.5))) == 2 and one(spark, R.mean_of(F.lit(None), F.lit("x"))) is None
    assert one(spark, R.seed(F.lit("7"), F.lit("a"))) == survey.stable_seed("7", "a")
    assert one(spark, X.epoch(F.lit("123.0"))) == 123 and one(spark, X.epoch(F.lit("x"))) is None and one(spark, X.day(F.lit(""))) == "unknown date"
    assert one(spark, X.word_count(F.lit("a b \x1c c"))) == 3 and one(spark, X.bare_id(F.lit("t1_x"))) == "x" and one(spark, X.key(F.lit("\t A  "))) == "a"
    assert one(spark, X.cues(F.lit("100% agree"))) == ["agreement"] and one(spark, X.cues(F.lit("disagreement"))) == []
    assert one(spark, X.refuses(F.lit("I'm sorry, but I can't"))) and not one(spark, X.refuses(F.lit("I canned it")))
    assert one(spark, X.background(F.lit("-0.04"), F.lit("0.06"), F.lit(""))).split("\n") == ["Community-embedding ideology signal: -0.040 (leans left/liberal, based on subreddit activity)", "Community-embedding gender signal: +0.060 (leans women, based on subreddit activity)"]


def test_session_plans(spark):
    people = readers.synthetic_agents(spark, 3).withColumn("state_case", F.lit(2))
    plan = session.session_plan(people)
    steps = {(r.profile_id, r.condition): r.n for r in plan.groupBy("profile_id", "condition").agg(F.count("*").alias("n")).collect()}
    assert len(steps) == 51 and all(n == {"Funding": 4, "Consensus": 4, "High public trust": 2}.get(c, 1) for (_, c), n in steps.items())
    again = session.session_plan(people.repartition(3))
    key = lambda p: sorted((r.profile_id, r.condition, r.step, r.seed, tuple(r.elements)) for r in p.collect())
    assert key(plan) == key(again)
    assert all(sorted(x for r in g for x in r.items if x in vocab.ITEM_KEYS) == sorted(vocab.ITEM_KEYS) for g in [plan.where("condition = 'Consensus' AND profile_id = 'agent_0001'").collect()])
    for mode, n in (("independent_blocks", 13), ("independent_items", 44)):
        got = session.session_plan(people, conditions=["control", "Funding"], mode=mode).where("profile_id = 'agent_0001'").collect()
        assert sum(r.independent for r in got if r.condition == "control") == n and sum(not r.independent for r in got if r.condition == "Funding") == 3
        assert all(r.items for r in got)
    assert session.session_plan(people, battery_steps=3, conditions=["control"]).count() == 9


def test_survey_to_tiers(spark):
    agents = readers.synthetic_agents(spark, 4)
    people = agents.select("profile_id", F.struct(*vocab.MODERATORS).alias("demographics"), "assigned_state", "year_birth", F.lit("text").alias("profile_text"))
    o = survey.RunOptions(conditions=["control", "Consensus"], pretreatment=True)
    pre = survey.run_pretreatment(people, survey.DummyClient, o)
    pre = spark.createDataFrame(pre.collect(), pre.schema)
    assert pre.count() == 4 and {x.status for x in pre.collect()} == {"complete"} and all(set(x.answers) == {"belief_pre", "trust_pre"} for x in pre.collect())
    r = survey.run_survey(people, survey.DummyClient, o, pretreatment=pre)
    r = spark.createDataFrame(r.collect(), r.schema).withColumns({"seq": F.lit(1), "timestamp": F.lit("t")})
    assert r.count() == 8 and {x.status for x in r.collect()} == {"complete"} and survey.usage(r).first().calls == 4 * (1 + 4)
    assert survey.usage(r, pre).first().calls == 4 * (1 + 4) + 4  # before the treatment each agent is asked once, not once a condition
    orders = {x.profile_id: x.block_order for x in pre.collect()}
    for x in r.collect():
        assert x.session_meta.pretreatment_order == orders[x.profile_id] and x.seconds >= 0
        assert sorted(x.session_meta.block_order) == sorted(k for _, k, _ in vocab.BLOCKS) and x.session_meta.block_order[0] == "trust_multidimensional"
    left = survey.run_survey(people, survey.DummyClient, survey.RunOptions(conditions=["control", "Consensus"]), done=r.where("condition = 'control'"))
    assert {x.condition for x in left.collect()} == {"Consensus"}
    worse = r.withColumns({"status": F.lit("failed"), "seq": F.lit(2)})
    best = tiers.usable_responses(r.unionByName(worse))
    raw = tiers.raw_export(best)
    assert raw.columns == tiers.RAW and len(tiers.RAW) == 69 and raw.where("`Duration (in seconds)` IS NULL").count() == 0
    t1 = tiers.tier1(raw)
    assert t1.columns == tiers.TIER1 and len(t1.columns) == 33 and t1.count() == 8
    a = t1.first()
    items = [a[c] for c in tiers.TRUST_NAMES]
    assert a.trust_multidimensional == pytest.approx(sum(items) / 12)
    out = tiers.derive_tiers(t1)
    main = {(x.condition, x.outcome): x.mean for x in out["tier2_main"].collect()}
    assert len(main) == 221 and out["tier2_moderator"].count() == 5967 and out["tier3"].count() == 208
    ate = {(x.condition, x.outcome): x.ate for x in out["tier3"].collect()}
    assert ate["Consensus", "trust_post"] == pytest.approx(main["Consensus", "trust_post"] - main["control", "trust_post"]) and ate["Funding", "trust_post"] is None
    rep = validate.validate_tier1(t1)
    assert rep.verdict == "WARN" and "WARN sample sizes" in rep.text()
    assert validate.validate_tier1(t1.withColumn("gender", F.lit("X"))).verdict == "FAIL"
    assert validate.sanity(out).verdict == "FAIL"  # conditions that no one was asked
    assert tiers.item_level(best).count() == 8


def test_inference_statuses(spark):
    moulds = spark.createDataFrame([("a", "2024-01-01 (r/x): hi", "")], "author string, mould string, background string")
    good = json.dumps({m: {"reasoning": "r", "top_guess": v[0], "alternates": [v[1]], "confidence": 60} for m, v in vocab.MODERATORS.items()})
    run = lambda text: survey.infer_attributes(moulds, lambda: survey.make_client("fixed:" + text)).first()
    ok = run("Sure. " + good)
    assert ok.status == "success" and ok.gender == "Male" and ok.party_confidence == 60.0 and ok.race_alternates == "Black / African American"
    assert run("I cannot do that").status == "refusal" and run("{}").status == "malformed_json"


def test_redaction_is_idempotent(spark, rows, tmp_path):
    calls = spark.createDataFrame([("p", "say"), ("q", None)], "id string, prompt string")
    once = redact.redact(calls)
    assert rows(once) == [("p", None, sinks.sha256_text("say")), ("q", None, None)] and rows(redact.redact(once)) == rows(once)
    assert redact.redaction_counts(calls).first().redacted == 1
    from panelworks.streaming import logs

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sinks.write_jsonl(calls, src)
    for _ in range(2):
        logs.redact_stream(spark, src, out, str(tmp_path / "cp"), "id string, prompt string").awaitTermination()
    assert rows(spark.read.schema("id string, prompt_sha256 string").json(out)) == [("p", sinks.sha256_text("say")), ("q", None)]


def test_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([("1", "é, \"x\"")], "a string, b string")
    p = str(tmp_path / "c")
    sinks.write_csv(df, p, ["b", "missing"])
    assert rows(readers.read_csv(spark, p)) == [("é, \"x\"", "")]
    with pytest.raises(Exception):
        sinks.write_csv(df, p)
    f = sinks.fingerprints(spark, p + "/part-*").first()
    assert len(f.sha256) == 64
    assert sinks.upsert_manifest([{"file": "a", "n": 1}, {"file": "example_b"}], [{"file": "a", "n": 2}]) == [{"file": "a", "n": 2}]
    assert sinks.citation({"team_id": "t", "tier": 1, "creators": [{"name": "N", "orcid": "0000-0002-1825-0097"}, {"name": "M", "orcid": "https://x"}]})["creators"] == [{"name": "N", "orcid": "0000-0002-1825-0097"}, {"name": "M"}]


def test_grid_and_ranges(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 120.0), ("b", "x", None)], "c string, o string, v double")
    g = validate.grid_completeness(df, ["c", "o"]).first()
    assert (g.cells, g.expected, g.complete) == (3, 4, False)
    assert tuple(validate.out_of_range(df, {"v": (0, 100)}).first()) == ("v", 1, 1)
    assert validate.validate_metadata({"status": "staged"}).verdict == "FAIL" and validate.validate_metadata({}).verdict == "FAIL"
