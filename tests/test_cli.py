import json

import pytest

from panelworks.functions import text as X
from panelworks.functions import vocab
from panelworks.operators import survey, tiers, validate
from panelworks.plans import cli
from panelworks.sources import readers, sinks


def test_steps_from_exports_to_coverage(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "subs.csv").write_text("author_key,id,created_utc,subreddit,text,title\nA,s1,1700000000,Texas,hello,T\nB,s2,1700000100,cats,hey,T\n")
    (tmp_path / "coms.csv").write_text("author_key,id,created_utc,subreddit,body,link_id,parent_id\nB,c1,1700000200,Texas,First take,t3_s1,t3_s1\n"
                                       "A,r1,1700000300,Texas,But you said that one two three four five six seven,t3_s1,t1_c1\n")
    (tmp_path / "states.csv").write_text("state;subreddit\ntexas;r/Texas\n")
    go = lambda *a: cli.main(list(a), spark)
    go("history", "--submissions", p("subs.csv"), "--comments", p("coms.csv"), "--output", p("h.csv"))
    go("pool", "--input", p("h.csv"), "--output", p("pool.csv"))
    assert readers.read_csv(spark, p("pool.csv")).count() == 3
    go("activity", "--input", p("h.csv"), "--counts-output", p("counts.csv"), "--activity-output", p("act.jsonl"))
    go("state", "--subreddit-counts", p("counts.csv"), "--state-subreddits", p("states.csv"), "--output", p("state.csv"))
    assert {(r.author, r.assigned_state, r.state_post_count) for r in readers.read_csv(spark, p("state.csv")).collect()} == {("a", "texas", "2"), ("b", "texas", "1")}
    (tmp_path / "scores.csv").write_text("community,partisan,gender,age\ntexas,0.5,0,0\n")
    go("scores", "--subreddit-scores", p("scores.csv"), "--user-activity", p("act.jsonl"), "--output", p("us.csv"))
    assert {r.ideology_score for r in readers.read_csv(spark, p("us.csv")).collect()} == {"0.5"}
    go("classify", "--input", p("h.csv"), "--output", p("c.csv"), "--missing-parent-ids-output", p("miss.csv"))
    go("interactions", "--input", p("c.csv"), "--output", p("i.csv"))
    (tmp_path / "agents.csv").write_text("profile_id,author," + ",".join(vocab.MODERATORS) + '\np1,A,Male,18-29,Other,Bachelor\'s degree,"Less than $30,000",Other\n')
    go("persona-posts", "--agents", p("agents.csv"), "--interactions", p("i.csv"), "--output", p("posts.jsonl"))
    go("personas", "--agents", p("agents.csv"), "--posts", p("posts.jsonl"), "--output", p("personas.jsonl"))
    go("coverage", "--agents", p("agents.csv"), "--posts", p("posts.jsonl"), "--output", p("cov.csv"), "--threshold", "5")
    assert readers.read_csv(spark, p("cov.csv")).first().n_posts == "1"
    go("infer", "--input", p("h.csv"), "--output", p("inf.jsonl"))
    assert {r.status for r in readers.read_jsonl(spark, p("inf.jsonl"), "status string").collect()} == {"malformed_json"}
    for _ in range(2):  # the second run finds all done
        go("survey", "--personas", p("personas.jsonl"), "--out-root", p("out"), "--conditions", "control", "Funding")
    go("submission", "--responses", p("out/responses-run.jsonl"), "--raw-output", p("raw.csv"), "--output", p("t1.csv"))
    assert readers.read_csv(spark, p("t1.csv")).columns == tiers.TIER1 and readers.read_csv(spark, p("t1.csv")).count() == 2
    go("tiers", "--tier1", p("t1.csv"), "--out-dir", p("t"))
    assert readers.read_csv(spark, p("t/tier3.csv")).count() == 208
    with pytest.raises(SystemExit) as e:
        go("check", "--input", p("t1.csv"))
    assert e.value.code == 0
    with pytest.raises(SystemExit):
        go("activity", "--input", p("h.csv"))


def test_small_helpers(spark, tmp_path):
    assert [X.duration(s) for s in (45, 185, 7440)] == ["45s", "3m 05s", "2h 04m"]
    schema = survey.response_schema(vocab.MODERATORS)
    assert schema["properties"]["party"]["properties"]["top_guess"]["enum"] == vocab.MODERATORS["party"]
    assert validate.validate_files(["a"], ["a", "b"], "- x: y\n- z:\n").verdict == "FAIL"
    f = tmp_path / "i.json"
    f.write_text(json.dumps({"SurveyElements": [{"Element": "SQ", "PrimaryAttribute": "Q1", "SecondaryAttribute": None, "Payload": {"a": 1}}]}))
    assert tuple(readers.instrument_elements(spark, str(f)).first()) == ("SQ", "Q1", None, '{"a":1}')
    assert sinks.dump({"é": 1}) == '{\n  "é": 1\n}\n'
