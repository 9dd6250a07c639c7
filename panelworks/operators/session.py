"""Survey sessions as tables: which pages and items each agent meets in each condition, step by step.

Random orders are orders by a hash of (seed, key), so they depend on the agent and condition alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recode as R
from ..functions import vocab

MODES = ("sequential", "independent_blocks", "independent_items")
#: Pages (p:) and items (i:) of each condition before the battery, by step.  {c1} {c2} {c3}: the consensus
#: statements in their random order; {case}: the agent's state case; {filler}: the control text drawn.
SCRIPTS = {
    vocab.CONTROL: [["p:{filler}"]],
    "Corporate reliance": [["p:corporate_reliance_p1", "p:corporate_reliance_p2"]], "Social justice": [["p:social_justice"]], "Interview Prof. Maraun": [["p:interview_maraun"]],
    "Oil industry misinformation": [["p:oil_industry_misinformation"]], "Measurement & modeling (1)": [["p:measurement_modeling_1"]], "Former skeptics": [["p:former_skeptics"]],
    "Measurement & modeling (2)": [["p:measurement_modeling_2"]], "Peer-review": [["p:peer_review"]], "Scientist community helpers": [[f"p:scientist_community_helpers_p{i}" for i in range(1, 5)]],
    "Portrait Prof. Cherry": [["p:portrait_cherry"]], "Model accuracy": [["p:model_accuracy"]], "Interview Prof. Sebille": [["p:interview_sebille"]],
    "Funding": [
        ["i:funding_value_1", "i:funding_value_2", "i:funding_value_3", "i:funding_value_4", "p:funding_p3_thanks", "i:funding_paid"], ["p:funding_p5_feedback_paid", "i:funding_federal"],
        ["p:funding_p7_feedback_federal", "i:funding_private"], ["p:funding_p9_feedback_private", "p:funding_p10_closing"]],
    "High public trust": [["i:public_trust_estimate"], ["p:high_public_trust_p2_feedback"]],
    "Consensus": [["p:consensus_intro", "i:consensus_{c1}"], ["p:consensus_fb_{c1}", "i:consensus_{c2}"], ["p:consensus_fb_{c2}", "i:consensus_{c3}"], ["p:consensus_fb_{c3}", "p:consensus_p_end"]],
    "Extreme weather predictions": [["p:extreme_weather_state_question", "p:extreme_weather_intro_case{case}", "p:extreme_weather_case{case}"]],
}
PREFIX = ["p:transition_to_study", "p:transition_pre_to_treatment"]
_POST = "p:transition_treatment_to_post"


def shuffled(seed: Column, keys: list[str]) -> Column:
    """The keys in an order that depends on the seed."""
    return F.transform(F.sort_array(F.array(*[F.struct(F.sha2(F.concat_ws("|", seed.cast("string"), F.lit(k)), 256).alias("h"), F.lit(k).alias("k")) for k in keys])), lambda x: x["k"])


def chosen(seed: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(seed, F.lit(len(options))) + 1).cast("int"))


def _block_elements() -> Column:
    """Block key -> its pages and items."""
    entries = []
    for _, key, items in vocab.BLOCKS:
        entries += [F.lit(key), F.array(*[F.lit(x) for x in ([f"p:{key}:pre_page"] if key in vocab.PRE_PAGES else []) + [f"i:{i}" for i in items]])]
    return F.create_map(*entries)


def _group(seed: Column, n: int) -> Column:
    return shuffled(seed, [k for g, k, _ in vocab.BLOCKS if g == n])


def condition_dim(spark: SparkSession, conditions: list[str] | None = None) -> DataFrame:
    names = {title: code for code, title in vocab.CODENAMES.items() if title != vocab.CONTROL}
    wanted = conditions or vocab.CONDITIONS
    if unknown := set(wanted) - set(vocab.CONDITIONS):
        raise ValueError(f"unknown conditions: {sorted(unknown)}")
    return spark.createDataFrame([(c, vocab.CONDITIONS.index(c), names.get(c), SCRIPTS[c]) for c in wanted], "condition string, ord int, code string, script array<array<string>>")


def session_plan(personas: DataFrame, seed: int = 7, conditions: list[str] | None = None, battery_steps: int = 1, mode: str = "sequential", pretreatment: bool = False) -> DataFrame:
    """``profile_id, condition, codename, seed, step, step_name, independent, elements, items``: a row per step.

    Steps without items are shown with the step behind them; in the independent modes with each battery step."""
    # Few agents make many sessions, so they are dealt out before the work.
    rows = pairs(personas, conditions).repartition(personas.sparkSession.sparkContext.defaultParallelism, "profile_id", "condition")
    rows = with_steps(rows, seed, battery_steps, mode, pretreatment)
    out = rows.select("profile_id", "condition", "ord", "codename", "seed", "prefix", F.posexplode_outer("steps").alias("step", "_s"))
    return out.select("profile_id", "condition", "ord", "codename", "seed", "prefix", "step", F.col("_s.name").alias("step_name"),
        F.col("_s.independent").alias("independent"), F.col("_s.elements").alias("elements"),
                      F.transform(F.filter("_s.elements", _is_item), lambda e: F.substr(e, F.lit(3))).alias("items"))


def _is_item(e: Column) -> Column:
    return F.startswith(e, F.lit("i:"))


def pairs(personas: DataFrame, conditions: list[str] | None = None, *keep) -> DataFrame:
    """Each agent in each condition, with what is kept of the agent; what with_steps makes sessions of."""
    dim = F.broadcast(condition_dim(personas.sparkSession, conditions))  # at most 17 rows
    case = F.coalesce(F.col("state_case"), F.lit(4)) if "state_case" in personas.columns else F.lit(4)
    return personas.select("profile_id", case.alias("_case"), *keep).crossJoin(dim)


def with_steps(rows: DataFrame, seed: int = 7, battery_steps: int = 1, mode: str = "sequential", pretreatment: bool = False) -> DataFrame:
    """pairs with ``seed, codename, prefix, steps``: a row per session, its steps (``name, independent, elements``) in order."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = rows.withColumn("seed", R.seed(F.lit(str(seed)), "profile_id", "condition", F.lit("")))
    rows = rows.withColumn("codename", F.coalesce("code", chosen(F.col("seed"), vocab.CONTROL_FILLERS)))
    rows = rows.withColumn("_c", shuffled(F.col("seed"), ["human", "co2", "year"]))

    def filled(x):
        for name, value in {"{filler}": F.replace("codename", F.lit(" "), F.lit("_")), "{case}": F.col("_case").cast("string"), **{f"{{c{i + 1}}}": F.get("_c", F.lit(i)) for i in range(3)}}.items():
            x = F.replace(x, F.lit(name), value)
        return x

    element = "struct<name:string,independent:boolean,elements:array<string>>"
    step = lambda name, independent, elements: F.struct(name.alias("name"), F.lit(independent).alias("independent"), elements.alias("elements"))
    # A column, so it is made once for all its uses.
    rows = rows.withColumn("_treat", F.transform("script", lambda s, i: step(F.concat(F.lit("treatment_"), (i + 1).cast("string")), False, F.transform(s, filled))))
    treat = F.col("_treat")
    blocks = _block_elements()
    of = lambda keys: F.flatten(F.transform(keys, lambda k: blocks[k]))
    first, second, third = F.array(F.lit("trust_multidimensional")), _group(F.col("seed"), 2), _group(F.col("seed"), 3)
    post = F.array(F.lit(_POST))
    if mode == "sequential":
        last = F.element_at(treat, -1)
        many = F.size(treat) > 1
        head = F.slice(treat, F.lit(1), F.size(treat) - 1)
        if battery_steps == 1:
            named = F.when(many, F.concat(last["name"], F.lit("+battery"))).otherwise(F.lit("battery"))
            steps = F.concat(head, F.array(step(named, False, F.concat(last["elements"], post, of(F.concat(first, second, third))))))
        else:
            named = F.when(many, F.concat(last["name"], F.lit("+battery_primary"))).otherwise(F.lit("battery_primary"))
            steps = F.concat(head, F.array(step(named, False, F.concat(last["elements"], post, of(first))), step(F.lit("battery_secondary"), False, of(second)),
                step(F.lit("battery_tertiary"), False, of(third))))
    else:
        all_blocks = F.concat(first, second, third)
        shared = F.flatten(F.transform(F.filter(treat, lambda s: ~F.exists(s["elements"], _is_item)), lambda s: s["elements"]))
        if mode == "independent_blocks":
            units = F.transform(all_blocks, lambda k: step(F.concat(F.lit("battery:"), k), True, F.concat(shared, post, blocks[k])))
        else:
            # A block's own page goes with its first item.
            units = F.flatten(F.transform(all_blocks, lambda k: F.transform(F.filter(blocks[k], _is_item), lambda e, i: step(
                F.concat(F.lit("battery:"), F.substr(e, F.lit(3))), True,
                    F.concat(shared, post, F.when(i == 0, F.filter(blocks[k], lambda x: ~_is_item(x))).otherwise(F.array().cast("array<string>")), F.array(e))))))
        steps = F.concat(F.filter(treat, lambda s: F.exists(s["elements"], _is_item)), units)
    rows = rows.withColumn("_steps", steps.cast(f"array<{element}>"))
    # Display-only steps are carried into the next step that has items.
    none = F.array().cast("array<string>")
    merged = F.aggregate(F.col("_steps"), F.struct(F.array().cast(f"array<{element}>").alias("done"), none.alias("carry")), lambda a, s: F.when(
        F.exists(s["elements"], _is_item), F.struct(F.concat(a["done"], F.array(F.struct(s["name"].alias("name"), s["independent"].alias("independent"),
            F.concat(a["carry"], s["elements"]).alias("elements")))).alias("done"), none.alias("carry"))
    ).otherwise(F.struct(a["done"].alias("done"), F.concat(a["carry"], s["elements"]).alias("carry"))))["done"]
    asked = F.transform(_pretreatment_order(seed), lambda k: F.concat(F.lit("i:"), k)) if pretreatment else F.array().cast("array<string>")
    prefix = F.concat(F.array(F.lit(PREFIX[0])), asked, F.array(F.lit(PREFIX[1])))
    # Apart from the generator, beside which names inside structs are lost.
    return rows.withColumns({"steps": merged, "prefix": prefix}).drop("_case", "_c", "_treat", "_steps", "code", "script")


def _pretreatment_seed(seed: int) -> Column:
    return R.seed(F.lit(str(seed)), "profile_id", F.lit("__pretreatment__"), F.lit(""))


def _pretreatment_order(seed: int) -> Column:
    return shuffled(_pretreatment_seed(seed), [i for _, items in vocab.PRE_BLOCKS for i in items])


def pretreatment_plan(personas: DataFrame, seed: int = 7) -> DataFrame:
    """The once-per-agent step with two items in the agent's random order."""
    order = _pretreatment_order(seed)
    elements = F.concat(F.array(F.lit(PREFIX[0])), F.transform(order, lambda k: F.concat(F.lit("i:"), k)))
    return personas.select("profile_id", _pretreatment_seed(seed).alias("seed"), order.alias("items"), elements.alias("elements"))
