"""Steps as commands: ``python -m panelworks.plans.cli STEP --option value ...``.  Stages meet through files; tables are CSV, JSON lines or
Parquet by suffix, and results are folders as Spark writes them."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..functions import text as X
from ..functions import vocab
from ..operators import activity, history, interactions, personas, redact, sampling, survey, threads, tiers, validate, weights
from ..functions import recode as R
from ..sources import external, readers, sinks

_PERSONA = f"profile_id string, author string, demographics struct<{','.join(f'{m}:string' for m in vocab.MODERATORS)}>, assigned_state string, state_case int, year_birth int, profile_text string, n_posts_included bigint, n_posts_total int, extra map<string,string>"
_POSTS = f"author string, posts array<{personas.POST}>"


def _save(df: DataFrame, path: str | None) -> None:
    if path:
        if path.endswith((".jsonl", ".json")):
            sinks.write_jsonl(df, path)
        elif path.endswith(".parquet"):
            df.write.parquet(path)
        else:
            sinks.write_csv(df, path)


def _history(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_table(spark, path)


def build(spark, a):
    read = lambda paths: [readers.read_csv(spark, p) for p in paths or []]
    subs, coms = read(a.submissions), read(a.comments)
    for raw in subs + coms:
        print(json.dumps(history.column_report(raw, a.author_column)))
    _save(history.build_history(subs, coms, a.author_column), a.output)


def pool(spark, a):
    _save(history.inference_pool(_history(spark, a.input)), a.output)


def counts(spark, a):
    if not (a.counts_output or a.activity_output):
        sys.exit("one of --counts-output and --activity-output is needed")
    c = activity.activity_counts(readers.read_csv(spark, a.input))
    _save(c.orderBy("author", F.desc("total"), "subreddit"), a.counts_output)
    _save(activity.activity_map(c), a.activity_output)


def state(spark, a):
    s = activity.assign_state(readers.read_table(spark, a.subreddit_counts), readers.read_states(spark, a.state_subreddits))
    _save(s, a.output)
    if a.merge_into:
        _save(activity.backfill(readers.read_table(spark, a.merge_into), s, "author", "assigned_state"), a.merged_output)


def scores(spark, a):
    act = readers.read_jsonl(spark, a.user_activity, "author string, subreddit_activity map<string,struct<total:bigint>>")
    table = readers.read_table(spark, a.subreddit_scores)
    known = table.withColumnRenamed("community", "subreddit").withColumn("subreddit", X.key("subreddit"))
    dims = [c for c in known.columns if c != "subreddit"]
    out = activity.weighted_scores(activity.explode_map(act), known, "subreddit", "author", "total", dims)
    names = {"partisan_score": "ideology_score", "n_total": "n_subreddits_total", "n_scored": "n_subreddits_scored"}
    _save(out.withColumnsRenamed(names), a.output)


def infer(spark, a):
    h = _history(spark, a.input).withColumn("seq", F.monotonically_increasing_id())
    if a.limit:
        h = readers.first_authors(h, a.limit)
    moulds = personas.author_mould(h, a.max_context_tokens)
    known = readers.read_table(spark, a.embedding_scores) if a.embedding_scores else None
    if known is not None:
        moulds = personas.with_background(moulds, known)
    if a.resume and readers.exists(spark, a.output):
        moulds = moulds.join(readers.read_jsonl(spark, a.output, "author string"), "author", "left_anti")
    http = a.model_client.split(":")[0] in ("http", "chat", "messages")
    options = {"base_url": a.base_url, "key_env": a.api_key_env, "extra_body": json.loads(a.extra_body or "{}")} if http else {}
    out = survey.infer_attributes(moulds, lambda: survey.make_client(a.model_client, **options), a.seed, a.workers or None)
    sinks.append_log(out, a.output) if a.resume else _save(out, a.output)


def sample(spark, a):
    extra = readers.read_table(spark, a.supplementary_pool) if a.supplementary_pool else None
    agents, report, told = sampling.stratified_sample(readers.read_table(spark, a.input), a.n, a.seed, extra, a.strict)
    _save(agents, a.output)
    _save(report, a.shortfall_report)
    print(json.dumps(told))
    if a.marginal_targets:
        sampling.achieved_margins(agents, readers.read_targets(spark, a.marginal_targets), ["party", "education", "income"]).show(100, False)


def classify(spark, a):
    c = threads.classify(_history(spark, a.input), readers.read_csv(spark, a.external_parents) if a.external_parents else None, readers.read_csv(spark, a.authors) if a.authors else None)
    _save(c, a.output)
    _save(threads.missing_parents(c), a.missing_parent_ids_output)


def extract(spark, a):
    c = readers.read_table(spark, a.input)
    relaxed = readers.read_csv(spark, a.relaxed_authors) if a.relaxed_authors else None
    if relaxed is not None and "min_words" not in relaxed.columns:
        relaxed = relaxed.withColumn("min_words", F.lit(str(a.relaxed_min_words)))
    found = interactions.meaningful(c, relaxed)
    _save(found, a.output)
    _save(interactions.pending_fetch(c), a.pending_fetch_output)
    interactions.cue_frequency(found).orderBy(F.desc("n")).show(50, False)


def persona_posts(spark, a):
    _save(personas.persona_posts(readers.read_table(spark, a.agents), readers.read_table(spark, a.interactions)), a.output)


def build_personas(spark, a):
    agents = personas.check_agents(readers.read_table(spark, a.agents))
    _save(personas.build_personas(agents, readers.read_jsonl(spark, a.posts, _POSTS), a.max_posts, a.max_chars_per_post, a.max_total_chars), a.output)


def coverage(spark, a):
    posts = readers.read_jsonl(spark, a.posts, _POSTS).select("author", F.explode("posts"))
    c = interactions.coverage(readers.read_table(spark, a.agents), posts)
    _save(c, a.output)
    _save(c.where(F.col("n_posts") < a.threshold).select("author"), a.below_threshold_output)
    interactions.coverage_stats(c).show()
    interactions.coverage_histogram(c).orderBy(F.col("n_posts").asc_nulls_last()).show(100, False)


def run(spark, a):
    people = readers.read_jsonl(spark, a.personas, _PERSONA)
    if a.only_agents:
        wanted = spark.createDataFrame([(x,) for x in a.only_agents], "profile_id string")
        from ..operators.budget import missing_ids

        if lost := [r.profile_id for r in missing_ids(wanted, people, "profile_id").collect()]:
            sys.exit(f"no such agents: {lost}")
        people = people.join(wanted, "profile_id", "left_semi")
    if a.limit_agents:
        people = people.orderBy("profile_id").limit(a.limit_agents)
    if people.isEmpty():
        sys.exit("no personas")
    config = readers.read_json_document(spark, a.config) if a.config else {}
    endpoint, second = config.pop("endpoint", {}), config.pop("cleanup_client", None)
    options = survey.RunOptions(**config)
    options.conditions, options.workers = a.conditions or options.conditions, a.workers or options.workers
    if a.print_prompt or a.print_all_steps:
        who, condition = a.print_prompt
        for i, (name, prompt) in enumerate(survey.prompts_of(people, who, condition, options)[: None if a.print_all_steps else 1]):
            print(f"--- step {i + 1}: {name} ---\n{prompt}\n")
        return
    endpoint |= {k: v for k, v in {"base_url": a.base_url, "key_env": a.api_key_env}.items() if v}
    http = lambda name: endpoint if name.split(":")[0] in ("http", "chat", "messages") else {}
    name = a.client
    tidy = (lambda: survey.make_client(second, **http(second))) if second else None
    summary = survey.run_to_log(spark, people, lambda: survey.make_client(name, **http(name)), a.out_root, options, a.run_id, tidy)
    print(sinks.dump(summary))


def _entry(spark, a) -> tuple[dict, str, str]:
    """(metadata, team, entry): options before what the metadata say."""
    meta = readers.read_json_document(spark, a.metadata) if a.metadata and readers.exists(spark, a.metadata) else {}
    return meta, a.team_id or meta.get("team_id") or "team", a.entry or meta.get("entry") or "primary"


def submission(spark, a):
    schema = survey.RESPONSE + ", run_id string, timestamp string, seq bigint"
    best = tiers.usable_responses(readers.read_jsonl(spark, a.responses, schema), a.include_partial)
    if best.isEmpty():
        sys.exit("no usable responses")
    raw = tiers.raw_export(best, a.run_id, profile_ids=a.profile_id_mode)
    if not a.out_dir:
        _save(raw, a.raw_output)
        _save(tiers.tier1(raw), a.output)
        return
    meta, team, entry = _entry(spark, a)
    name = sinks.bundle_name(team, 1, entry, a.version)
    _save(raw, f"{a.out_dir}/{team}_raw_export_{a.run_id}.csv")
    sinks.write_csv(tiers.tier1(raw), f"{a.out_dir}/{name}", one_file=True)
    _save(tiers.item_level(best), f"{a.out_dir}/item_level_{a.run_id}.csv")
    if a.metadata and meta and not a.no_manifest:
        entry = {"file": name, "sha256": sinks.fingerprint(spark, f"{a.out_dir}/{name}")}
        sinks.put_text(spark, a.metadata, sinks.dump(meta | {"prediction_files": sinks.upsert_manifest(meta.get("prediction_files", []), [entry])}))


def derive(spark, a):
    t1 = tiers.check_tier1(readers.read_table(spark, a.tier1).replace("", None)).persist()
    _, team, entry = _entry(spark, a)
    made = tiers.derive_tiers(t1, a.decimals)
    named = a.team_id or a.metadata
    names = {"tier2_main": sinks.bundle_name(team, 2, entry, a.version, "main"), "tier2_moderator": sinks.bundle_name(team, 2, entry, a.version, "moderator"),
        "tier3": sinks.bundle_name(team, 3, entry, a.version)}
    for kind, df in made.items():
        _save(df, f"{a.out_dir}/{names[kind] if named else kind + '.csv'}")
    sizes = t1.groupBy("condition").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    filled = tiers.fallback_cells(t1).groupBy("moderator", "moderator_level").agg(F.count(F.lit(1)).alias("n")).collect()
    report = validate.sanity(made)
    told = {"verdict": report.verdict, "checks": [list(r) for r in report.rows], "n_rows": sizes.rows, "respondents_per_condition": {"min": sizes.least, "max": sizes.most},
            "moderator_fallback_cells": sum(r.n for r in filled), "moderator_fallback_levels": sorted(f"{r.moderator}={r.moderator_level}" for r in filled)}
    sinks.put_text(spark, f"{a.out_dir}/derive_tiers_report.json", sinks.dump(told))
    print(sinks.dump(told))


def check(spark, a):
    if a.bundle:
        r = validate.validate_bundle(spark, a.bundle)
    else:
        tier = {"1": validate.validate_tier1, "2": validate.validate_tier2_main, "2m": validate.validate_tier2_moderator, "3": validate.validate_tier3}[a.tier]
        r = tier(readers.read_csv(spark, a.input).replace("", None))
    print(r.text())
    sys.exit(int(r.verdict == validate.FAIL))


def redact_calls(spark, a):
    _save(redact.redact(spark.read.json(a.input)), a.output)


def census(spark, a):
    external.register(spark)
    raw = spark.read.format("census").option("url", a.url).option("columns", "AGEP,SEX,HISP,RAC1P,SCHL,PINCP,PWGTP").load()
    people = R.recode_person(raw).withColumn("w", R.number("PWGTP")).where("age_band IS NOT NULL")
    _save(weights.weighted_marginals(people, ["gender", "age_band", "race", "education", "income"], "w"), f"{a.out_dir}/marginals.csv")
    for other in ("age_band", "race"):
        _save(weights.weighted_crosstab(people, [other, "gender"], "w"), f"{a.out_dir}/{other}_by_gender.csv")


def party(spark, a):
    external.register(spark)
    people = spark.read.format("stata").option("path", a.input).option("columns", f"{a.variable},{a.weight}").load().select(R.party(a.variable).alias("party"), F.col(a.weight).alias("w"))
    _save(weights.weighted_marginals(people, ["party"], "w"), a.output)


#: Step -> (function, options).  An option: name, or (name, default), or (name, kind, default); ``+`` takes several, ``?`` is a flag.
STEPS = {
    "history": (build, ["submissions+", "comments+", "output!", ("author-column", "author_key")]),
    "pool": (pool, ["input!", "output!"]),
    "activity": (counts, ["input+!", "counts-output", "activity-output"]),
    "state": (state, ["subreddit-counts!", "state-subreddits!", "output!", "merge-into", "merged-output"]),
    "scores": (scores, ["subreddit-scores!", "user-activity!", "output!"]),
    "infer": (infer, ["input!", "embedding-scores", "output!", ("model-client", "dummy"), "base-url", "api-key-env", ("max-context-tokens", 3000), ("seed", 42),
        ("limit", 0), "resume?", ("workers", 0), "extra-body"]),
    "sample": (sample, ["input!", "output!", "shortfall-report", "supplementary-pool", ("n", 1000), ("seed", 42), "strict?", "marginal-targets+"]),
    "classify": (classify, ["input!", "authors", "external-parents", "output!", "missing-parent-ids-output"]),
    "interactions": (extract, ["input!", "output!", "pending-fetch-output", "relaxed-authors", ("relaxed-min-words", 10)]),
    "persona-posts": (persona_posts, ["agents!", "interactions!", "output!"]),
    "personas": (build_personas, ["agents!", "posts!", "output!", ("max-posts", 60), ("max-chars-per-post", 600), ("max-total-chars", 16000)]),
    "coverage": (coverage, ["agents!", "posts!", "output", ("threshold", 10), "below-threshold-output"]),
    "survey": (run, ["config", "personas!", "out-root!", ("run-id", "run"), ("limit-agents", 0), "only-agents+", "conditions+", ("workers", 0), ("client", "dummy"),
        "base-url", "api-key-env", "print-prompt+", "print-all-steps?"]),
    "submission": (submission, ["responses!", "raw-output", "output", "out-dir", "metadata", "team-id", "entry", ("version", 1), "no-manifest?", ("run-id", "run"),
        "include-partial?", ("profile-id-mode", "agent")]),
    "tiers": (derive, ["tier1!", "out-dir!", "metadata", "team-id", "entry", ("version", 1), ("decimals", 3)]),
    "check": (check, ["input", "bundle", ("tier", "1")]),
    "redact": (redact_calls, ["input!", "output!"]),
    "census": (census, ["url!", "out-dir!"]),
    "party": (party, ["input!", ("variable", "pid3"), ("weight", "commonweight"), "output!"]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelworks", description=__doc__)
    steps = p.add_subparsers(dest="step", required=True)
    for name, (_, options) in STEPS.items():
        s = steps.add_parser(name)
        for o in options:
            o, default = o if isinstance(o, tuple) else (o, None)
            flag = f"--{o.strip('+!?')}"
            if o.endswith("?"):
                s.add_argument(flag, action="store_true")
            else:
                s.add_argument(flag, default=default, required="!" in o, **({"nargs": "+"} if "+" in o else {}), **({"type": type(default)} if default is not None else {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"panelworks {a.step}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    STEPS[a.step][0](spark, a)


if __name__ == "__main__":
    main()
