"""A deposit from responses to a checked bundle."""

import json
import os

import pytest
from pyspark.sql import functions as F

from panelworks.functions import vocab
from panelworks.operators import tiers, validate
from panelworks.plans import catalog_tiers, cli
from panelworks.sources import readers, sinks

D = "/root/testdata/sf0.001"


GOOD = {"team_id": "t", "team_name": "T", "contact": "a@b", "tier": 1, "entry": "primary", "models": ["m"], "approach_family": "f", "disclosure_class": "A", "escrow_doi": None, "blinding_attestation": True,
        "coverage": {"interventions": 16, "outcomes": 13}, "prediction_files": [{"file": "predictions/t_T1_primary_v1.csv", "sha256": "AB"}]}


@pytest.mark.parametrize("change, failed, warned", [
    ({}, [], []), ({"team_name": ""}, ["team_name given"], []), ({"contact": None}, ["contact given"], []), ({"tier": 4}, ["tier"], None), ({"tier": "1"}, [], []), ({"entry": "zzz"}, ["entry"], []), ({"entry": "secondary-12"}, [], []),
    ({"models": []}, ["models listed"], []), ({"approach_family": None}, ["approach_family given"], []), ({"disclosure_class": "D"}, ["disclosure_class"], []), ({"escrow_doi": "10.1/x"}, [], ["no escrow for class A"]),
    ({"disclosure_class": "B"}, [], ["escrow for class B"]), ({"disclosure_class": "C", "escrow_doi": "10.1/x"}, [], []), ({"blinding_attestation": "true"}, ["blinding attested"], []),
    ({"coverage": None}, ["coverage given", "coverage full"], []), ({"coverage": {"interventions": 15, "outcomes": 13}}, ["coverage full"], []), ({"prediction_files": []}, ["prediction files listed"], []),
    ({"prediction_files": [{"file": "predictions/example_T1.csv", "sha256": "1"}]}, [], ["staged for t"]), ({"prediction_files": GOOD["prediction_files"] * 2}, [], ["file count for tier 1"]),
    ({"tier": 2}, ["predictions/t_T1_primary_v1.csv name"], ["file count for tier 2"]), ({"prediction_files": [{"file": "t_T1_primary_v2.csv", "sha256": "1"}]}, ["t_T1_primary_v2.csv present"], []),
    ({"prediction_files": [{"file": "predictions/t_T1_primary_v1.csv", "sha256": "cd"}]}, ["predictions/t_T1_primary_v1.csv sha256"], [])])
def test_metadata_rules(change, failed, warned):
    name = "predictions/t_T1_primary_v1.csv"
    r = validate.validate_metadata(GOOD | change, [name], {name: "ab"})
    of = lambda status: [c for c, s, _ in r.rows if s == status]
    assert (of("FAIL") == failed or change.get("tier") == 4) and (warned is None or of("WARN") == warned)
    assert r.verdict == ("FAIL" if failed else "WARN" if warned else "PASS")


def test_blank_answers():
    form = "# A\n- **1.1 Label** — prompt:\n  an answer\n- **1.2 Label** — prompt:\n\n- **1.3 Label** - prompt:\n- **1.4 Label** — prompt: given\n- **1.5 L** — p:\n## B\ntext that ends so:\n- **1.6 L** — p:"
    assert [x[4:7] for x in validate.blank_answers(form)] == ["1.2", "1.3", "1.5", "1.6"]


def test_citation_record():
    made = sinks.citation(GOOD | {"creators": [{"name": "N, M", "affiliation": "U", "orcid": "0000-0002-1825-0097"}, {"name": "O, P", "orcid": "https://orcid.org/0000-0002-1825-0097"}], "abstract": "One.\n \nTwo.", "code_repository": "https://x/y"})
    assert made["creators"] == [{"name": "N, M", "affiliation": "U", "orcid": "0000-0002-1825-0097"}, {"name": "O, P"}] and made["description"] == "<p>One.</p><p>Two.</p>"
    assert (made["upload_type"], made["version"], made["license"], made["related_identifiers"][0]["relation"]) == ("software", "1.0-t1", "CC-BY-4.0", "isCompiledBy")
    assert validate.validate_citation(made).verdict == "PASS"
    bare = sinks.citation(GOOD)
    assert bare["creators"] == [{"name": sinks.NO_NAME, "affiliation": "Your institution"}] and "Model(s): m" in bare["description"]
    warned = lambda change: [c for c, s, _ in validate.validate_citation(made | change).rows if s == "WARN"]
    assert [c for c, s, _ in validate.validate_citation(bare).rows if s == "WARN"] == ["creators filled in"]
    assert warned({"upload_type": "x"}) == ["upload_type"] and warned({"access_right": "x"}) == ["access_right"] and warned({"license": ""}) == ["licence"] and warned({"keywords": ["a", ""]}) == ["keywords"]
    assert warned({"creators": [{"name": "N", "orcid": "0000-0000-0000-0000"}]}) == ["ORCIDs"] and warned({"related_identifiers": [{"identifier": "x", "relation": "likes"}]}) == ["related identifiers"] and warned({"title": ""}) == ["title, description and creator"]
    with pytest.raises(ValueError):
        sinks.citation({"tier": 1})


def test_a_whole_folder(spark, tmp_path):
    r = validate.validate_repository(spark, str(tmp_path))
    assert {"metadata.json present", "survey present", "predictions hold a CSV"} <= {c for c, s, _ in r.rows if s == "FAIL"}
    for d in ("survey", "predictions", "raw_data_deposit"):
        (tmp_path / d).mkdir()
    for f, t in {"metadata.json": json.dumps(GOOD | {"code_repository": "https://x/your-team/your-repo", "prediction_files": [{"file": "predictions/example_a.csv", "sha256": "x"}]}), "registration.md": "- **1 L** — p:\n  yes\n", "codebook.csv": "a\n", ".zenodo.json": json.dumps(sinks.citation(GOOD)),
                 "predictions/example_a.csv": "a\n", "raw_data_deposit/example_raw_export.csv": "a\n"}.items():
        (tmp_path / f).write_text(t)
    r = validate.validate_repository(spark, str(tmp_path))
    assert r.verdict == "WARN"
    assert [c for c, s, _ in r.rows if s == "WARN"] == ["survey/survey.qsf present", "code repository given", "citation: creators filled in", "no example predictions left", "no example raw export left", "staged for t"]
    (tmp_path / ".zenodo.json").write_text("{")
    assert "citation record is JSON" in {c for c, s, _ in validate.validate_repository(spark, str(tmp_path)).rows if s == "FAIL"}


def test_many_unknown_labels_hide_nothing(spark):
    """Values out of range are counted whatever number of labels there is."""
    row = {"profile_id": "p", "condition": "x", **{m: v[0] for m, v in vocab.MODERATORS.items()}, **{c: 50 for c in tiers.TRUST_NAMES}, **{o: hi for o, (_, hi) in vocab.OUTCOMES.items()}}
    df = spark.range(400).select(*[F.lit(v).alias(k) for k, v in row.items() if k not in ("profile_id", "condition")], F.col("id").cast("string").alias("profile_id"), F.concat(F.lit("odd "), "id").alias("condition"))
    df = df.withColumn("trust_post", F.lit(400)).withColumns({c: F.lit(None) for c in tiers.TIER1 if c not in df.columns})
    found = {c: (s, d) for c, s, d in validate.validate_tier1(df).rows}
    assert found["trust_post range"] == ("FAIL", "400 values outside") and found["condition labels"][0] == "FAIL"


@pytest.mark.parametrize("name, tier, ok", [("t_T1_primary_v1.csv", 1, True), ("t_T1_secondary-2_v10.csv", 1, True), ("t_T1_other_v1.csv", 1, False), ("t_T2_primary_v1.csv", 2, False), ("t_T2_primary_v1_cells_main.csv", 2, True), ("u_T1_primary_v1.csv", 1, False)])
def test_names(name, tier, ok):
    assert validate.file_name_ok(name, "t", tier) is ok


def test_from_responses_to_a_checked_bundle(spark, tmp_path, capsys):
    p = lambda n: str(tmp_path / n)
    people = spark.range(3).select(F.format_string("p%d", "id").alias("profile_id"), F.lit("a").alias("author"), F.struct(*[F.lit(v[0]).alias(m) for m, v in vocab.MODERATORS.items()]).alias("demographics"),
                                   F.lit("Texas").alias("assigned_state"), F.lit(1).alias("state_case"), F.lit(2000).alias("year_birth"), F.lit("t").alias("profile_text"))
    sinks.write_jsonl(people, p("people.jsonl"))
    meta = GOOD | {"team_id": "team9", "entry": "secondary-1", "prediction_files": [{"file": "example_x.csv", "sha256": "0"}]}
    (tmp_path / "deposit").mkdir()
    (tmp_path / "deposit" / "metadata.json").write_text(json.dumps(meta))
    go = lambda *a: cli.main(list(a), spark)
    go("survey", "--personas", p("people.jsonl"), "--out-root", p("out"), "--conditions", "control", "Funding")
    go("submission", "--responses", p("out/responses-run.jsonl"), "--out-dir", p("deposit"), "--metadata", p("deposit/metadata.json"), "--version", "3")
    files = json.loads((tmp_path / "deposit" / "metadata.json").read_text())["prediction_files"]
    assert [e["file"] for e in files] == ["team9_T1_secondary-1_v3.csv"] and files[0]["sha256"] == sinks.fingerprint(spark, p("deposit/" + files[0]["file"]))
    assert readers.read_csv(spark, p("deposit/item_level_run.csv")).count() == 6
    r = validate.validate_bundle(spark, p("deposit"))
    status = {c: s for c, s, _ in r.rows}
    assert status["team9_T1_secondary-1_v3.csv name"] == status["team9_T1_secondary-1_v3.csv sha256"] == status["team9_T1_secondary-1_v3.csv: columns"] == "PASS" and r.verdict == "WARN"
    with pytest.raises(SystemExit) as e:
        go("check", "--bundle", p("deposit"))
    assert e.value.code == 0
    go("tiers", "--tier1", p("deposit/team9_T1_secondary-1_v3.csv"), "--out-dir", p("derived"), "--metadata", p("deposit/metadata.json"))
    told = json.loads((tmp_path / "derived" / "derive_tiers_report.json").read_text())
    assert readers.read_csv(spark, p("derived/team9_T3_secondary-1_v1.csv")).count() == 208 and told["verdict"] == "FAIL" and told["moderator_fallback_cells"] > 0
    (tmp_path / "deposit" / "metadata.json").write_text(json.dumps(meta | {"prediction_files": [{"file": "lost.csv", "sha256": "0"}]}))
    assert validate.validate_bundle(spark, p("deposit")).verdict == "FAIL"


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
def test_tier1_must_be_known(spark):
    t1 = tiers.tier1(catalog_tiers.raw(spark, D))
    assert tiers.check_tier1(t1) is t1
    with pytest.raises(ValueError, match="lacks columns"):
        tiers.check_tier1(t1.drop("donation_ams"))
    for odd in (F.lit("Martian"), F.lit(None).cast("string")):
        with pytest.raises(ValueError, match="unknown conditions.*(Martian|None)"):
            tiers.check_tier1(t1.withColumn("condition", odd))
    assert tiers.check_tier1(t1.withColumn("party", F.lit("Martian"))).count() == t1.count()
    some = t1.where("condition = 'control' AND gender = 'Male'")
    cells = tiers.fallback_cells(some)
    assert cells.where("condition = 'control' AND moderator = 'gender' AND moderator_level = 'Male'").count() == 0
    assert cells.where("condition = 'control' AND moderator = 'gender' AND moderator_level = 'Female'").count() == 13
