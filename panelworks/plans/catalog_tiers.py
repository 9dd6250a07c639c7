"""Queries over the way from raw exports to individual tables, means, effects and reports, with orders as responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..operators import tiers, validate
from ..sources import readers, sinks
from . import catalog_recodes
from .registry import query, rounded, scratch, sql_values, table

_NAMES = list(vocab.CODENAMES)
_M = vocab.MODERATORS
_CODED = ["gender", "race", "education", "income", "party"]
_ITEMS = [k for k in vocab.ITEM_KEYS if k not in vocab.CHOICES]


def raw(spark, sf_dir) -> DataFrame:
    """Orders as a raw export, through a file as such exports come: every item has a value that follows from the key, or none."""
    k = F.col("o_orderkey")
    item = lambda i: F.when((k + i) % 13 != 0, (k * (i + 7) % 101).cast("string"))
    made = {
        "profile_id": X.in_pieces(F.concat(F.lit("p"), k.cast("string"))), "condition": F.element_at(F.array(*[F.lit(c) for c in _NAMES]), (k % len(_NAMES) + 1).cast("int")),
            "year_birth": F.concat(F.lit("born "), (1930 + k % 70).cast("string")),
        **{m: ((k + j) % len(_M[m]) + 1).cast("string") for j, m in enumerate(_CODED)}, **{key: item(i) for i, key in enumerate(_ITEMS)},
            "donation": (k % 11).cast("string"), "newsletter": (k % 2 + 1).cast("string"),
    }
    path = scratch(spark, "raw")
    sinks.write_csv(table(spark, sf_dir, "orders").select(*[made.get(c, F.lit("")).alias(c) for c in tiers.RAW]), path)
    return readers.read_csv(spark, path, columns=tiers.RAW, multi_line=False)


def _list(options) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def _item(key: str) -> str:
    i = _ITEMS.index(key)
    return f"CASE WHEN (k + {i}) % 13 <> 0 THEN CAST(k * {i + 7} % 101 AS DOUBLE) END"


def _mean(keys) -> str:
    return "list_avg([" + ", ".join(map(_item, keys)) + "])"


_COLUMNS = {
    "profile_id": "'p' || k", "condition": f"({_list([vocab.CODENAMES[n] for n in _NAMES])})[k % {len(_NAMES)} + 1]",
        "age_band": "CASE WHEN 96 - k % 70 <= 29 THEN '18-29' WHEN 96 - k % 70 <= 44 THEN '30-44' WHEN 96 - k % 70 <= 59 THEN '45-59' ELSE '60+' END",
    **{m: f"({_list(_M[m])})[(k + {j}) % {len(_M[m])} + 1]" for j, m in enumerate(_CODED)}, **{new: _item(old) for old, new in tiers.RENAMES.items()},
        **{out: _item(k) for out, k in vocab.SINGLES.items()}, "funding_perceptions": f"100 - {_item('funding_5')}",
    **{out: "list_avg([" + ", ".join(map(_mean, groups)) + "])" for out, groups in vocab.COMPOSITES.items()}, "donation_ams": "CAST(k % 11 AS INT)",
        "newsletter_signup": "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END",
}
_T1 = "WITH t1 AS (SELECT " + ", ".join(f"{_COLUMNS[c]} AS {c}" for c in tiers.TIER1) + " FROM (SELECT o_orderkey AS k FROM orders))"


@query(_T1 + " SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in vocab.COMPOSITES else c for c in tiers.TIER1) + " FROM t1")
def individual_scores(spark, sf_dir):
    """The individual-level table: levels, renamed items, reversed items, two-level composites."""
    return tiers.tier1(raw(spark, sf_dir)).withColumns({c: rounded(c) for c in vocab.COMPOSITES})


_OUTCOMES = list(vocab.OUTCOMES)
_CELLS = ", ".join(f"avg({o}) AS {o}" for o in _OUTCOMES)
_LONG = f"unnest({_list(_OUTCOMES)}) AS outcome, unnest([{', '.join(f'CAST({o} AS DOUBLE)' for o in _OUTCOMES)}]) AS mean"
_GRID = f"SELECT condition, outcome FROM (SELECT unnest({_list(vocab.CONDITIONS)}) AS condition), (SELECT unnest({_list(_OUTCOMES)}) AS outcome)"
_TIER2 = f"""{_T1}, m AS (SELECT condition, {_LONG} FROM (SELECT condition, {_CELLS} FROM t1 GROUP BY 1)), main AS (SELECT g.condition, g.outcome, mean FROM ({_GRID}) g LEFT JOIN m USING (condition, outcome))
"""


@query(_TIER2 + "SELECT condition, outcome, round(mean, 9) AS mean FROM main")
def dense_condition_means(spark, sf_dir):
    """All conditions by all outcomes."""
    return tiers.tier2_main(tiers.tier1(raw(spark, sf_dir), ordered=False)).withColumn("mean", rounded("mean", 9))


_MODS = list(_M)


@query(_TIER2 + f"""
, c AS (SELECT condition, moderator, level, {_LONG} FROM (SELECT condition, CASE {" ".join(f"WHEN grouping({m}) = 0 THEN '{m}'" for m in _MODS)} END AS moderator, coalesce({", ".join(_MODS)}) AS level, {_CELLS} FROM t1
  GROUP BY GROUPING SETS ({", ".join(f"(condition, {m})" for m in _MODS)}))),
l AS (SELECT * FROM (VALUES {sql_values([(m, v) for m, vs in _M.items() for v in vs])}) v(moderator, moderator_level))
SELECT main.condition, l.moderator, l.moderator_level, main.outcome, round(coalesce(c.mean, main.mean), 9) AS mean FROM main CROSS JOIN l
LEFT JOIN c ON c.condition = main.condition AND c.outcome = main.outcome AND c.moderator = l.moderator AND c.level = l.moderator_level
""")
def dense_moderator_means(spark, sf_dir):
    """All conditions, moderator levels and outcomes; an empty cell has its condition's mean."""
    return tiers.tier2_moderator(tiers.tier1(raw(spark, sf_dir), ordered=False)).withColumn("mean", rounded("mean", 9))


@query(_TIER2 + "SELECT m.condition, m.outcome, round(m.mean - b.mean, 9) AS ate FROM main m JOIN main b ON b.outcome = m.outcome AND b.condition = 'control' WHERE m.condition <> 'control'")
def dense_effects(spark, sf_dir):
    return tiers.tier3(tiers.tier2_main(tiers.tier1(raw(spark, sf_dir), ordered=False))).withColumn("ate", rounded("ate", 9))


def _answer(key: str) -> str:
    """An item's value from what the stand-in answered."""
    value = f"max(answer) FILTER (WHERE key = '{key}')"
    return f"CAST({value} AS DOUBLE)" if key not in vocab.CHOICES else value


def _answers_mean(keys) -> str:
    return "list_avg([" + ", ".join(map(_answer, keys)) + "])"


_SURVEYED = {
    "profile_id": "profile_id", "condition": "condition", **{m: f"({_list(_M[m])})[(any_value(c_custkey) + {j}) % {len(_M[m])} + 1]" for j, m in enumerate(_M)},
    **{new: _answer(old) for old, new in tiers.RENAMES.items()}, **{out: _answer(k) for out, k in vocab.SINGLES.items()}, "funding_perceptions": f"100 - {_answer('funding_5')}",
    **{out: "round(list_avg([" + ", ".join(map(_answers_mean, groups)) + "]), 6)" for out, groups in vocab.COMPOSITES.items()},
    "donation_ams": f"CAST(substr({_answer('donation')}, 4) AS INT)", "newsletter_signup": f"CASE WHEN {_answer('newsletter')} = 'News1' THEN 1 ELSE 0 END",
}


@query(catalog_recodes._ANSWERED + "SELECT " + ", ".join(f"{_SURVEYED[c]} AS {c}" for c in tiers.TIER1) + " FROM a GROUP BY profile_id, condition")
def individual_table(spark, sf_dir):
    """The whole way: sessions, the latest best response, raw export, scores."""
    # What an export needs: the best of several is picked from whole rows, which are narrow as exported.
    told = catalog_recodes._surveyed(spark, sf_dir, "codename", "answers", "demographics", "year_birth", "seconds")
    best = tiers.usable_responses(tiers.with_export(told.withColumn("seq", F.lit(0))))
    return tiers.tier1(tiers.raw_export(best)).withColumns({c: rounded(c) for c in vocab.COMPOSITES})


# --- Reports -------------------------------------------------------------------------------------------------------------

def _checks(rows: list[tuple[str, str, str]]) -> str:
    """(check, condition under which it holds, status otherwise) -> SELECTs over one row of counts."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", CASE WHEN {ok} THEN 'PASS' ELSE '{bad}' END AS status FROM n" for c, ok, bad in rows)


_RANGED = {**{c: (0, 100) for c in tiers.TRUST_NAMES}, **vocab.OUTCOMES}
_COUNTS = ", ".join([
    "count(*) AS total", "count(DISTINCT profile_id) AS ids", "count(DISTINCT condition) AS conditions", *[f"count(*) FILTER (WHERE {m} IS NULL) AS no_{m}" for m in _MODS],
    *[f"count(*) FILTER (WHERE {c} IS NULL) AS no_{c}, count(*) FILTER (WHERE NOT {c} BETWEEN {lo} AND {hi}) AS out_{c}" for c, (lo, hi) in _RANGED.items()]])
_SMALL = "(SELECT count(*) FROM (SELECT condition, count(*) AS n FROM t1 GROUP BY 1) WHERE n < CASE WHEN condition = 'control' THEN 1000 ELSE 500 END)"


@query(f"""{_T1}, n AS (SELECT {_COUNTS}, {_SMALL} AS small FROM t1)
""" + _checks([
    ("columns", "true", "FAIL"), ("condition labels", "true", "FAIL"), ("condition all present", f"conditions = {len(vocab.CONDITIONS)}", "WARN"),
    *[x for m in _MODS for x in ((f"{m} labels", "true", "FAIL"), (f"{m} known", f"no_{m} < greatest(1, total)", "FAIL"), (f"{m} mostly known", f"no_{m} <= 0.1 * total", "WARN"))],
    ("sample sizes", "small = 0", "WARN"), ("profile_id unique", "ids = total", "WARN"), ("composite agrees with items", "true", "WARN"),
    *[x for c in _RANGED for x in ((f"{c} range", f"out_{c} = 0", "FAIL"), (f"{c} present", f"no_{c} = 0", "WARN"))], ("donation whole dollars", "true", "FAIL"),
        ("newsletter binary", "true", "FAIL")]))
def tier1_report(spark, sf_dir):
    """All checks of an individual-level table."""
    return validate.validate_tier1(tiers.tier1(raw(spark, sf_dir), ordered=False)).frame(spark).select("check", "status")


_KNOWN = "[" + ", ".join(f"'{c}'" for c in vocab.CONDITIONS) + "]"


@query(_TIER2 + f", n AS (SELECT count(*) AS cells, count(DISTINCT condition) AS conditions, count(mean) AS known FROM main WHERE condition IN (SELECT condition FROM t1)) " + _checks([
    ("columns", "true", "FAIL"), ("condition labels", "true", "FAIL"), ("condition all present", f"conditions = {len(vocab.CONDITIONS)}", "WARN"),
        ("outcome labels", "true", "FAIL"), ("outcome all present", "true", "WARN"),
    ("no repeated cells", "true", "FAIL"), ("all cells", f"cells = {len(vocab.CONDITIONS) * len(_OUTCOMES)}", "FAIL"), ("no missing values", "known = cells", "FAIL"), ("ranges", "true", "FAIL")]))
def tier2_report(spark, sf_dir):
    """Checks of condition means of those conditions that there are."""
    means = tiers.condition_means(tiers.tier1(raw(spark, sf_dir), ordered=False), "condition", _OUTCOMES)
    return validate.validate_tier2_main(means).frame(spark).select("check", "status")


@query(_TIER2 + ", n AS (SELECT count(*) FILTER (WHERE condition = 'control') AS control, count(*) AS cells FROM main) " + _checks([
    ("columns", "true", "FAIL"), ("no control rows", "control = 0", "FAIL"), ("condition labels", "control = 0", "FAIL"), ("condition all present", "true", "WARN"),
        ("outcome labels", "true", "FAIL"), ("outcome all present", "true", "WARN"),
    ("no repeated cells", "cells = 0", "FAIL"), ("all cells", f"cells = {(len(vocab.CONDITIONS) - 1) * len(_OUTCOMES)}", "FAIL"), ("no missing values", "false", "FAIL")]))
def tier3_report(spark, sf_dir):
    """Checks of effects among which control was left, each cell there twice and one value lost."""
    main = tiers.tier2_main(tiers.tier1(raw(spark, sf_dir), ordered=False)).withColumnRenamed("mean", "ate")
    lost = main.withColumn("ate", F.when((F.col("condition") != "Funding") | (F.col("outcome") != "trust_post"), F.col("ate")))
    return validate.validate_tier3(lost.unionByName(lost)).frame(spark).select("check", "status")


def _spoiled(t1: DataFrame) -> DataFrame:
    """An individual-level table in which every check of labels, ids, sizes, values and composites has something to find."""
    k = F.substr(F.col("profile_id"), F.lit(2)).cast("bigint")
    changed = {
        "profile_id": F.concat(F.lit("p"), (k % 7001).cast("string")), "condition": F.when(k % 97 == 0, "nowhere").when(k % 101 == 0, None).otherwise(F.col("condition")),
        **{m: F.when((k + j) % 53 == 0, "Martian").when(k % (5 + 3 * j) == 0, None).otherwise(F.col(m)) for j, m in enumerate(_MODS)},
            "trust_multidimensional": F.col("trust_multidimensional") + (k % 211 == 0).cast("int") * 5,
        "trust_post": F.when(k % 41 == 0, 400.0).otherwise(F.col("trust_post")), "donation_ams": F.when(k % 31 == 0, 2.5).otherwise(F.col("donation_ams")),
            "newsletter_signup": F.when(k % 37 == 0, 2).otherwise(F.col("newsletter_signup")),
    }
    return t1.withColumns(changed)


def _in(column: str, known) -> str:
    return f"{column} IN ({', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in known)})"


_SPOILED = f"""{_T1}, w AS (SELECT *, CAST(substr(profile_id, 2) AS BIGINT) AS k FROM t1),
v AS (SELECT * EXCLUDE k REPLACE ('p' || (k % 7001) AS profile_id, CASE WHEN k % 97 = 0 THEN 'nowhere' WHEN k % 101 <> 0 THEN condition END AS condition,
  {", ".join(f"CASE WHEN (k + {j}) % 53 = 0 THEN 'Martian' WHEN k % {5 + 3 * j} <> 0 THEN {m} END AS {m}" for j, m in enumerate(_MODS))}, trust_multidimensional + CASE WHEN k % 211 = 0 THEN 5 ELSE 0 END AS trust_multidimensional,
  CASE WHEN k % 41 = 0 THEN 400 ELSE trust_post END AS trust_post, CASE WHEN k % 31 = 0 THEN 2.5 ELSE donation_ams END AS donation_ams, CASE WHEN k % 37 = 0 THEN 2 ELSE newsletter_signup END AS newsletter_signup) FROM w),
n AS (SELECT {_COUNTS.replace("count(DISTINCT condition) AS conditions", f"count(DISTINCT condition) FILTER (WHERE {_in('condition', vocab.CONDITIONS)}) AS conditions")},
  count(*) FILTER (WHERE NOT {_in("condition", vocab.CONDITIONS)}) AS odd_condition, {", ".join(f"count(*) FILTER (WHERE NOT {_in(m, _M[m])}) AS odd_{m}" for m in _MODS)},
  (SELECT count(*) FROM (SELECT condition, count(*) AS n FROM v GROUP BY 1) WHERE (condition IS NULL OR {_in("condition", vocab.CONDITIONS)}) AND n < CASE WHEN condition = 'control' THEN 1000 ELSE 500 END) AS small,
  max(abs(list_avg([{", ".join("list_avg([" + ", ".join(tiers.TRUST_NAMES[i : i + 3]) + "])" for i in range(0, 12, 3))}]) - trust_multidimensional)) AS off,
  count(*) FILTER (WHERE donation_ams <> round(donation_ams)) AS fractions, count(*) FILTER (WHERE newsletter_signup NOT IN (0, 1)) AS other FROM v)
"""


@query(_SPOILED + _checks([
    ("columns", "true", "FAIL"), ("condition labels", "odd_condition = 0", "FAIL"), ("condition all present", f"conditions = {len(vocab.CONDITIONS)}", "WARN"),
    *[x for m in _MODS for x in ((f"{m} labels", f"odd_{m} = 0", "FAIL"), (f"{m} known", f"no_{m} < greatest(1, total)", "FAIL"), (f"{m} mostly known", f"no_{m} <= 0.1 * total", "WARN"))],
    ("sample sizes", "small = 0", "WARN"), ("profile_id unique", "ids = total", "WARN"), ("composite agrees with items", "off IS NULL OR off <= 0.51", "WARN"),
    *[x for c in _RANGED for x in ((f"{c} range", f"out_{c} = 0", "FAIL"), (f"{c} present", f"no_{c} = 0", "WARN"))], ("donation whole dollars", "fractions = 0", "FAIL"),
        ("newsletter binary", "other = 0", "FAIL")]))
def tier1_report_of_faults(spark, sf_dir):
    """The same checks where they fail."""
    return validate.validate_tier1(_spoiled(tiers.tier1(raw(spark, sf_dir), ordered=False))).frame(spark).select("check", "status")


@query(_TIER2 + f""", b AS (SELECT * FROM (VALUES {sql_values([(o, lo, hi) for o, (lo, hi) in vocab.OUTCOMES.items()])}) b(outcome, lo, hi)),
v AS (SELECT condition, CASE WHEN condition = 'Funding' AND outcome = 'trust_post' THEN 'odd' ELSE outcome END AS outcome, CASE WHEN outcome = 'belief_post' THEN mean + 200 WHEN outcome <> 'concern_mean' THEN mean END AS mean FROM main),
u AS (SELECT * FROM v WHERE condition <> 'Peer-review' UNION ALL SELECT * FROM v WHERE condition = 'control'),
n AS (SELECT count(*) FILTER (WHERE NOT {_in("condition", vocab.CONDITIONS)}) AS odd_condition, count(DISTINCT condition) AS conditions, count(*) FILTER (WHERE NOT {_in("outcome", _OUTCOMES)}) AS odd_outcome, count(DISTINCT outcome) FILTER (WHERE {_in("outcome", _OUTCOMES)}) AS outcomes,
  count(*) - count(DISTINCT (condition, outcome)) AS twice, count(DISTINCT (condition, outcome)) AS cells, count(*) - count(mean) AS missing, count(*) FILTER (WHERE NOT mean BETWEEN lo AND hi) AS outside FROM u LEFT JOIN b USING (outcome))
""" + _checks([
    ("columns", "true", "FAIL"), ("condition labels", "odd_condition = 0", "FAIL"), ("condition all present", f"conditions = {len(vocab.CONDITIONS)}", "WARN"),
        ("outcome labels", "odd_outcome = 0", "FAIL"), ("outcome all present", f"outcomes = {len(_OUTCOMES)}", "WARN"),
    ("no repeated cells", "twice = 0", "FAIL"), ("all cells", f"cells = {len(vocab.CONDITIONS) * len(_OUTCOMES)}", "FAIL"), ("no missing values", "missing = 0", "FAIL"),
        ("ranges", "outside = 0", "FAIL")]))
def tier2_report_of_faults(spark, sf_dir):
    """Condition means with an unknown outcome, a condition that lacks, one that is there twice, values that lack and values outside their range."""
    main = tiers.tier2_main(tiers.tier1(raw(spark, sf_dir), ordered=False))
    outcome = F.when((F.col("condition") == "Funding") & (F.col("outcome") == "trust_post"), "odd").otherwise(F.col("outcome"))
    mean = F.when(F.col("outcome") == "belief_post", F.col("mean") + 200).when(F.col("outcome") != "concern_mean", F.col("mean"))
    spoiled = main.select("condition", outcome.alias("outcome"), mean.alias("mean"))
    means = spoiled.where("condition <> 'Peer-review'").unionByName(spoiled.where("condition = 'control'"))
    return validate.validate_tier2_main(means).frame(spark).select("check", "status")


@query("SELECT CASE WHEN count(*) FILTER (WHERE l_quantity > 45) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE l_tax IS NULL) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM lineitem")
def verdict_of_checks(spark, sf_dir):
    """The worst status of a report is its verdict."""
    r = validate.Report()
    for x in validate.out_of_range(table(spark, sf_dir, "lineitem"), {"l_quantity": (0, 45), "l_tax": (0, 1)}).collect():
        r.add(f"{x.column} range", x.outside == 0)
        r.add(f"{x.column} present", x.missing == 0, otherwise=validate.WARN)
    return spark.createDataFrame([(r.verdict,)], "verdict string")


@query("SELECT r_name AS file, r_regionkey < 3 AS present, CASE WHEN r_regionkey < 3 THEN r_regionkey <> 1 END AS same FROM region")
def metadata_of_files(spark, sf_dir):
    """Files that metadata names: those that are there, and whether their hashes agree."""
    names = [(r.r_name, r.r_regionkey) for r in table(spark, sf_dir, "region").collect()]
    meta = {"team_id": "t", "entry": "primary", "tier": 1, "prediction_files": [{"file": n, "sha256": "x"} for n, _ in names]}
    report = validate.validate_metadata(meta, [n for n, k in names if k < 3], {n: "y" if k == 1 else "x" for n, k in names})
    status = {c: s == validate.PASS for c, s, _ in report.rows}
    return spark.createDataFrame([(n, status[f"{n} present"], status.get(f"{n} sha256")) for n, _ in names], "file string, present boolean, same boolean")


# --- Exports -------------------------------------------------------------------------------------------------------------

def responses(spark, sf_dir) -> DataFrame:
    """Customers as responses in one condition, all items answered."""
    k = F.col("c_custkey")
    answer = lambda i, key: F.element_at(F.array(*[F.lit(s) for s, _, _ in vocab.CHOICES[key]]),
        (k % len(vocab.CHOICES[key]) + 1).cast("int")) if key in vocab.CHOICES else ((k + i) % 101).cast("string")
    level = lambda j, m: F.element_at(F.array(*[F.lit(x) for x in _M[m]]), ((k + j) % len(_M[m]) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("profile_id"), F.lit("Peer-review").alias("condition"), F.lit("honored haddock").alias("codename"),
            F.create_map(*[x for i, key in enumerate(vocab.ITEM_KEYS) for x in (F.lit(key), answer(i, key))]).alias("answers"),
        F.create_map(*[F.lit("trust_post_1"), (k % 50).cast("int")]).alias("speculation"), F.create_map(*[x for j, m in enumerate(_M) for x in (F.lit(m),
            level(j, m))]).alias("demographics"), F.lit(None).cast("int").alias("year_birth"),
        F.lit("complete").alias("status"), F.lit(1).alias("n_calls"), F.lit("m").alias("model"), F.lit("Texas").alias("assigned_state"), (-k).alias("first_seen"), (k % 90 + 0.4).alias("seconds"))


@query("""
SELECT printf('R_x_%06d', row_number() OVER (ORDER BY -c_custkey) - 1) AS "ResponseId", c_custkey || '__peer_review' AS profile_id, 'honored haddock' AS condition, CAST(c_custkey % 90 AS BIGINT) AS seconds, CAST(c_custkey % 3 + 1 AS INT) AS gender,
  CAST(2026 - ([24, 37, 52, 68])[(c_custkey + 1) % 4 + 1] AS INT) AS year_birth, CAST(c_custkey % 11 AS INT) AS donation, CAST(c_custkey % 2 + 1 AS INT) AS newsletter, CAST((c_custkey + 12) % 101 AS INT) AS trust_post_1 FROM customer
""")
def raw_export_rows(spark, sf_dir):
    """Responses as a raw export: ids in the order of first sight, codes, exported values, stand-in years."""
    made = tiers.raw_export(responses(spark, sf_dir), "x", profile_ids="row")
    return made.select("ResponseId", "profile_id", "condition", F.col("Duration (in seconds)").alias("seconds"), "gender", "year_birth", "donation", "newsletter", "trust_post_1")


@query("SELECT CAST(c_custkey AS VARCHAR) AS profile_id, CAST((c_custkey + 12) % 101 AS VARCHAR) AS trust_post_1, 'Don' || (c_custkey % 11) AS donation, CAST(c_custkey % 50 AS INT) AS spec_trust_post_1, (['Male', 'Female', 'Other'])[c_custkey % 3 + 1] AS demo_gender FROM customer")
def item_level_rows(spark, sf_dir):
    """Answers and speculation of responses as columns."""
    return tiers.item_level(responses(spark, sf_dir)).select("profile_id", "trust_post_1", "donation", "spec_trust_post_1", "demo_gender")
