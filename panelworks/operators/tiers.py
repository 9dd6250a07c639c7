"""Responses to analytic tables: raw export, individual level, condition means, moderator means, effects against control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import recode as R
from ..functions import vocab
from ..functions.text import in_pieces
from ..scratch import written
from .budget import latest_best, status_rank
from .order import numbered

#: Names of single items in the individual-level table.
TRUST_NAMES = [f"trust_{s}_{i}" for s in ("competence", "integrity", "benevolence", "openness") for i in (1, 2, 3)]
RENAMES = dict(zip(vocab.ITEM_KEYS[:12], TRUST_NAMES, strict=True))
TIER1 = ["profile_id", "condition", *vocab.MODERATORS, "trust_multidimensional", *TRUST_NAMES, "trust_post", "distrust_post", "funding_perceptions", "policy_role_mean",
    "inst_trust_mean", "belief_post", "concern_mean",
         "policy_general", "policy_specific_mean", "behavior_mean", "donation_ams", "newsletter_signup"]
SYSTEM = ["StartDate", "EndDate", "Status", "IPAddress", "Progress", "Duration (in seconds)", "Finished", "RecordedDate", "ResponseId", "RecipientLastName",
    "RecipientFirstName", "RecipientEmail", "ExternalReference", "LocationLatitude", "LocationLongitude", "DistributionChannel", "UserLanguage"]
RAW = [*SYSTEM, "condition", "profile_id", "gender", "year_birth", "race", "education", "income", "party", "donation", "newsletter",
    *[k for k in vocab.ITEM_KEYS if k not in ("donation", "newsletter")]]


def usable_responses(responses: DataFrame, include_partial: bool = False, seq: str = "seq") -> DataFrame:
    """The latest best response of each agent and condition, failed ones left out."""
    best = latest_best(responses, ["profile_id", "condition"], status_rank(), seq)
    return best.where(F.col("status").isin(*(["complete", "partial"] if include_partial else ["complete"])))


def export_value(key: str, answer: Column) -> Column:
    if key in vocab.CHOICES:
        return R.code_map(answer, {s: v for s, _, v in vocab.CHOICES[key]})
    return R.number(answer).cast("int")


def with_export(responses: DataFrame, profile_ids: str = "agent") -> DataFrame:
    """``profile_id, condition, seq, status`` and the like of responses, with ``_raw``: what a raw export has of each, its ResponseId apart.
    Answers and levels, which it has the values of, are left out, so what is moved and ordered from here on is narrow."""
    is_map = dict(responses.dtypes)["demographics"].startswith("map")
    # A column each, so that a map is searched once for each key.
    found = {**{f"_demo_{m}": F.col("demographics").getItem(m) if is_map else F.col(f"demographics.{m}") for m in vocab.MODERATORS},
        **{f"_said_{k}": F.col("answers").getItem(k) for k in vocab.ITEM_KEYS}}
    kept = [c for c in responses.columns if c not in ("answers", "speculation", "explanations", "demographics", "calls", "session_meta", "missing_outcome_items")]
    responses = responses.select(*kept, *[x.alias(c) for c, x in found.items()])
    code = lambda m: R.code_map(f"_demo_{m}", {level: i for i, level in enumerate(vocab.MODERATORS[m], 1)})
    pid = F.col("profile_id") if profile_ids == "agent" else F.concat(F.col("profile_id"), F.lit("__"), R.slug("condition"))
    at = F.coalesce(F.col("timestamp").cast("string"), F.lit("")) if "timestamp" in responses.columns else F.lit("")
    made = {
        "StartDate": at, "EndDate": at, "RecordedDate": at, "Status": F.lit(0), "Progress": F.lit(100), "Finished": F.lit(1), "DistributionChannel": F.lit("anonymous"), "UserLanguage": F.lit("EN"),
        "Duration (in seconds)": F.round("seconds").cast("bigint") if "seconds" in responses.columns else F.lit(None).cast("bigint"),
        "condition": F.col("codename"), "profile_id": in_pieces(pid),
        "year_birth": F.coalesce(F.col("year_birth"), vocab.SURVEY_YEAR - R.code_map("_demo_age_band", vocab.BAND_AGE)), **{m: code(m) for m in ("gender", "race", "education", "income", "party")},
        **{k: export_value(k, F.col(f"_said_{k}")) for k in vocab.ITEM_KEYS},
    }
    return responses.select(*kept, F.struct(*[x.alias(c) for c, x in made.items()]).alias("_raw"))


def raw_export(responses: DataFrame, run_id: str = "run", order: Sequence = ("first_seen",), profile_ids: str = "agent") -> DataFrame:
    """Responses, or what with_export made of them, as a raw survey export: codes for levels, exported values for answers, blanks as null.
    profile_ids: ``agent``, or ``row`` for ids that differ by condition."""
    made = responses if "_raw" in responses.columns else with_export(responses, profile_ids)
    made = numbered(made, [*order, "profile_id", "condition"], "_row")
    there = {f.name: F.col("_raw").getField(f.name) for f in made.schema["_raw"].dataType.fields}
    there["ResponseId"] = F.format_string(f"R_{run_id.replace('%', '%%')}_%06d", "_row")
    return made.select(*[there.get(c, F.lit(None).cast("string")).alias(c) for c in RAW])


def tier1(raw: DataFrame, ordered: bool = True) -> DataFrame:
    """A raw export as the individual-level table, in the order of conditions.  Unknown codes, levels and conditions are errors.

    What is put in order is written first, since a sort reads each row twice, once to find the ranges of its tasks; ordered=False for
    what is counted or averaged next."""
    aliases = {"race": {"White/Caucasian": "White / Caucasian", "African-American": "Black / African American", "Hispanic": "Hispanic / Latino", "Asian-American": "Asian / Asian American"}}
    # Numbers and levels are columns before anything is made of them, so each is made once.
    levels = {m: R.decode(m, vocab.MODERATORS[m], aliases.get(m)) for m in ("gender", "race", "education", "income", "party")}
    raw = raw.select("profile_id", R.condition("condition").alias("condition"), R.birth_year("year_birth").alias("_year"), *[x.alias(m) for m, x in levels.items()],
        R.binary("newsletter").alias("_newsletter"), *[R.number(k).alias(k) for k in vocab.ITEM_KEYS])
    n = {k: F.col(k) for k in vocab.ITEM_KEYS}
    made = {
        "profile_id": in_pieces(F.col("profile_id").cast("string")), "condition": F.col("condition"), "age_band": R.age_band(vocab.SURVEY_YEAR - F.col("_year")),
        **{m: F.col(m) for m in levels},
        **{new: n[old] for old, new in RENAMES.items()}, **{out: n[k] for out, k in vocab.SINGLES.items()}, "funding_perceptions": R.reverse(n["funding_5"]),
        **{out: R.composite(groups, F.col) for out, groups in vocab.COMPOSITES.items()},
        "donation_ams": R.half_even(n["donation"]).cast("int"), "newsletter_signup": F.col("_newsletter"),
    }
    made = raw.select(*[made[c].alias(c) for c in TIER1])
    return in_order(written(made, "tier1")) if ordered else made


def in_order(df: DataFrame) -> DataFrame:
    place = R.code_map("condition", {c: i for i, c in enumerate(vocab.CONDITIONS)})
    return df.orderBy(place, "profile_id")


def item_level(responses: DataFrame, keys: Sequence[str] = vocab.ITEM_KEYS) -> DataFrame:
    """Answers and speculation of each response as columns."""
    return responses.select("profile_id", "condition", "codename", "status", "n_calls", "model", *[F.col("demographics").getItem(m).alias(f"demo_{m}") for m in vocab.MODERATORS], "assigned_state",
                            *[F.col("answers").getItem(k).alias(k) for k in keys], *[F.col("speculation").getItem(k).alias(f"spec_{k}") for k in keys])


# --- Means and effects -------------------------------------------------------------------------------------------------

def _levels(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{name}` string, `{name}_ord` int"))


def condition_means(df: DataFrame, condition: str, outcomes: Sequence[str]) -> DataFrame:
    """``condition, outcome, mean``: means of what is there; not-a-number counts as missing."""
    means = df.groupBy(condition).agg(*[F.avg(R.number_in(df, o)).alias(o) for o in outcomes])
    return means.unpivot([condition], list(outcomes), "outcome", "mean")


def moderator_means(df: DataFrame, condition: str, moderators: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """``condition, moderator, moderator_level, outcome, mean`` by grouping sets: one pass for all moderators."""
    view = df.select(condition, *[F.col(m).cast("string").alias(m) for m in moderators], *[R.number_in(df, o).alias(o) for o in outcomes])
    # grouping() is 0 for the moderator that a row is grouped by.
    which = F.coalesce(*[F.when(F.grouping(m) == 0, F.lit(m)) for m in moderators])
    sets = [[F.col(condition), F.col(m)] for m in moderators]
    grouped = view.groupingSets(sets, condition, *moderators).agg(which.alias("moderator"),
        F.coalesce(*[F.when(F.grouping(m) == 0, F.col(m)) for m in moderators]).alias("moderator_level"), *[F.avg(o).alias(o) for o in outcomes])
    grouped = grouped.select(condition, "moderator", "moderator_level", *outcomes)
    return grouped.where("moderator_level IS NOT NULL").unpivot([condition, "moderator", "moderator_level"], list(outcomes), "outcome", "mean")


def effects(means: DataFrame, condition: str, control: str, keys: Sequence[str] = ("outcome",)) -> DataFrame:
    """``condition, outcome, ate``: each mean less the control's."""
    # Each row meets its control by a window, not by a join, which would make all means twice.
    base = F.collect_list(F.when(F.col(condition) == control, F.struct("mean"))).over(Window.partitionBy(*keys))
    met = means.dropna(subset=list(keys)).withColumn("_base", base).where(F.col(condition) != control)
    return met.select(condition, *keys, "mean", F.explode("_base").alias("_base")).select(condition, *keys, (F.col("mean") - F.col("_base.mean")).alias("ate"))


def tier2_main(t1: DataFrame) -> DataFrame:
    """All conditions x outcomes, null where no one was asked."""
    spark = t1.sparkSession
    grid = _levels(spark, "condition", vocab.CONDITIONS).crossJoin(_levels(spark, "outcome", list(vocab.OUTCOMES)))
    return grid.join(condition_means(t1, "condition", list(vocab.OUTCOMES)), ["condition", "outcome"], "left").select("condition", "outcome", "mean")


def tier2_moderator(t1: DataFrame) -> DataFrame:
    """All conditions x moderator levels x outcomes; an empty cell has its condition's mean."""
    spark = t1.sparkSession
    levels = F.broadcast(spark.createDataFrame([(m, v) for m, vs in vocab.MODERATORS.items() for v in vs], "moderator string, moderator_level string"))
    grid = _levels(spark, "condition", vocab.CONDITIONS).crossJoin(levels).crossJoin(_levels(spark, "outcome", list(vocab.OUTCOMES)))
    cells = moderator_means(t1, "condition", list(vocab.MODERATORS), list(vocab.OUTCOMES))
    main = tier2_main(t1).withColumnRenamed("mean", "_main")
    return grid.join(cells, ["condition", "moderator", "moderator_level", "outcome"], "left").join(main, ["condition", "outcome"], "left").select("condition",
        "moderator", "moderator_level", "outcome", F.coalesce("mean", "_main").alias("mean"))


def check_tier1(t1: DataFrame) -> DataFrame:
    """The table as it came; an error where a column lacks, or a condition is null or not known.  Levels of moderators that are not
    known stay: they are in no cell."""
    lacking = [c for c in ["profile_id", "condition", *vocab.MODERATORS, *vocab.OUTCOMES] if c not in t1.columns]
    if lacking:
        raise ValueError(f"tier 1 lacks columns: {lacking}")
    odd = t1.where(F.col("condition").isNull() | ~F.col("condition").isin(vocab.CONDITIONS)).select("condition").distinct().limit(20).collect()
    if odd:
        raise ValueError(f"tier 1 has unknown conditions: {sorted(str(x.condition) for x in odd)}")
    return t1


def fallback_cells(t1: DataFrame) -> DataFrame:
    """``condition, moderator, moderator_level, outcome``: the cells that no one answered, which have their condition's mean."""
    cells = moderator_means(t1, "condition", list(vocab.MODERATORS), list(vocab.OUTCOMES)).where("mean IS NOT NULL")
    keys = ["condition", "moderator", "moderator_level", "outcome"]
    return tier2_moderator(t1).select(*keys).join(cells.select(*keys), keys, "left_anti")


def tier3(main: DataFrame) -> DataFrame:
    return effects(main, "condition", vocab.CONTROL)


def derive_tiers(t1: DataFrame, decimals: int | None = 3) -> dict[str, DataFrame]:
    main = tier2_main(t1)
    out = {"tier2_main": main, "tier2_moderator": tier2_moderator(t1), "tier3": tier3(main)}
    if decimals is not None:
        out = {k: v.withColumn(c, R.half_even(c, decimals)) for k, v in out.items() for c in ["ate" if k == "tier3" else "mean"]}
    return out
