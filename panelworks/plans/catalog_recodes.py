"""Queries over recodes, text functions, personas and parsers, on codes and texts made of the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..functions import answers as A
from ..functions import recode as R
from ..functions import text as X
from ..functions import vocab
from ..operators import budget, interactions, personas, sampling, session, survey, threads, validate
from .registry import query, rounded, sql_values, table


def _pick(options: list, by) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (by % len(options) + 1).cast("int"))


def _sql_list(options: list) -> str:
    return "[" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in options) + "]"


def _case(pairs, other="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN '" + str(b).replace("'", "''") + "'" for a, b in pairs) + f" ELSE {other} END"


# --- Codes ---------------------------------------------------------------------------------------------------------------

_M = vocab.MODERATORS


@query(f"""
SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Other' END AS gender,
  {_case([("p_size * 2 < 18", ""), ("p_size * 2 <= 29", "18-29"), ("p_size * 2 <= 44", "30-44"), ("p_size * 2 <= 59", "45-59")], "'60+'").replace("THEN ''", "THEN NULL")} AS age_band,
  CASE WHEN p_size % 5 <> 1 THEN 'Hispanic / Latino' ELSE {_case([("p_size % 9 + 1 = 1", _M["race"][0]), ("p_size % 9 + 1 = 2", _M["race"][1]), ("p_size % 9 + 1 = 6", _M["race"][3])], "'Other'")} END AS race,
  {_case([("p_size <= 15", _M["education"][0]), ("p_size <= 17", _M["education"][1]), ("p_size <= 20", _M["education"][2]), ("p_size = 21", _M["education"][3]), ("p_size <= 23", _M["education"][4]), ("p_size = 24", _M["education"][5])])} AS education,
  {_case([("x < 30000", _M["income"][0]), ("x < 56000", _M["income"][1]), ("x < 100000", _M["income"][2]), ("x < 168000", _M["income"][3])], "'" + _M["income"][4] + "'")} AS income
FROM (SELECT *, p_retailprice * 90 AS x FROM part)
""")
def person_recodes(spark, sf_dir):
    """A census record's codes as levels, all at once."""
    s = F.col("p_size")
    raw = table(spark, sf_dir, "part").select("p_partkey", (s % 4).alias("SEX"), (s * 2).alias("AGEP"), (s % 5).alias("HISP"), (s % 9 + 1).alias("RAC1P"),
        s.alias("SCHL"), (F.col("p_retailprice") * 90).alias("PINCP"))
    return R.recode_person(raw).select("p_partkey", *_RECODED)


_RECODED = ["gender", "age_band", "race", "education", "income"]
_RACES = ["1", " 2 ", "hispanic / LATINO", "Asian-American", "Other", "", None]
_RACES_MEAN = [_M["race"][0], _M["race"][1], _M["race"][2], _M["race"][3], "Other", None, None]


@query(f"SELECT c_custkey, ({_sql_list(_RACES_MEAN)})[c_custkey % 7 + 1] AS race FROM customer")
def decoded_levels(spark, sf_dir):
    """Codes, labels in any case, aliases and blanks."""
    return table(spark, sf_dir, "customer").select("c_custkey", R.decode(_pick(_RACES, F.col("c_custkey")), _M["race"], {"Asian-American": _M["race"][3]}).alias("race"))


_YES = ["1", "1.0", " YES ", "true", "0", "2", "2.00", "No", "maybe", "", None]


@query(f"SELECT c_custkey, ({_sql_list([1, 1, 1, 1, 0, 0, 0, 0, None, None, None])})[c_custkey % 11 + 1] AS yes FROM customer")
def tolerant_binaries(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", R.binary(_pick(_YES, F.col("c_custkey"))).alias("yes"))


_CODES = [*vocab.CODENAMES.items(), *((c, c) for c in vocab.CONDITIONS), ("", None)]


@query(f"SELECT o_orderkey, ({_sql_list([t for _, t in _CODES])})[o_orderkey % {len(_CODES)} + 1] AS condition FROM orders")
def condition_titles(spark, sf_dir):
    """Code names with odd white space, and titles, as titles."""
    said = F.concat(F.lit(" "), F.replace(_pick([c for c, _ in _CODES], F.col("o_orderkey")), F.lit(" "), F.lit("  ")), F.lit("\t"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.condition(said).alias("condition"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_quantity / 2 AS DOUBLE), 0) AS BIGINT) AS whole FROM lineitem")
def rounded_half_even(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.half_even(F.col("l_quantity") / 2).cast("bigint").alias("whole"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_size >= 18 THEN 2026 - p_size ELSE 2002 END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 1989 ELSE 1974 END ELSE 1958 END AS year FROM part
""")
def birth_year_resolution(spark, sf_dir):
    """An age of the band gives the year; a year that misses the band, or none at all, the band's stand-in."""
    s = F.col("p_size")
    age = F.when(s % 3 == 0, F.greatest(s, F.lit(18)).cast("string"))
    band = F.when(s % 3 == 0, F.when(s < 18, "18-29").otherwise(R.age_band(s))).when((s % 3 == 1) & (s % 2 == 0), "30-44").when(s % 3 == 1, "45-59").otherwise("60+")
    year = F.when(s % 3 == 1, "2001").when((s % 3 == 0) & (s < 18), "1950")
    return table(spark, sf_dir, "part").select("p_partkey", R.resolved_birth_year(year, F.lit(None).cast("string"), age, band).alias("year"))


@query("SELECT c_custkey, d = 10 AS x_digit, true AS ok, false AS short_ok FROM (SELECT *, (12 - t % 11) % 11 AS d FROM (SELECT c_custkey, list_sum(list_transform(range(1, 16), lambda i: CAST(substr(lpad(CAST(c_custkey * 7919 AS VARCHAR), 15, '0'), CAST(i AS INT), 1) AS BIGINT) * (1 << CAST(16 - i AS INT)))) AS t FROM customer))")
def orcid_checksums(spark, sf_dir):
    """Ids with the right check digit, and the same without their hyphens."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919).cast("string"), 15, "0").alias("base"))
    digit = lambda i: F.substr("base", F.lit(i), F.lit(1)).cast("bigint")
    total = sum((digit(i) * 2 ** (16 - i) for i in range(2, 16)), digit(1) * 2**15)
    rows = rows.withColumn("check", (F.lit(12) - total % 11) % 11)
    rows = rows.withColumn("digits", F.concat("base", F.when(F.col("check") == 10, "X").otherwise(F.col("check").cast("string"))))
    parts = F.concat_ws("-", *[F.substr("digits", F.lit(i), F.lit(4)) for i in (1, 5, 9, 13)])
    return rows.select("c_custkey", (F.col("check") == 10).alias("x_digit"), R.orcid_ok(parts).alias("ok"), R.orcid_ok("digits").alias("short_ok"))


@query("SELECT c_custkey, 'Community-embedding ideology signal: ' || printf('%+.3f', c_acctbal / 7) || CASE WHEN c_acctbal > 0 THEN ' (leans right/conservative' ELSE ' (leans left/liberal' END || ', based on subreddit activity)' AS told FROM customer")
def background_lines(spark, sf_dir):
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", X.background((F.col("c_acctbal") / 7).cast("string"), nothing, nothing).alias("told"))


_DON = vocab.CHOICES["donation"]


@query("SELECT c_custkey, c_nationkey % 11 AS dollars, c_nationkey % 2 + 1 AS newsletter, c_nationkey * 4 AS slider FROM customer")
def export_values(spark, sf_dir):
    from ..operators import tiers

    n = F.col("c_nationkey")
    value = lambda k, a: tiers.export_value(k, a)
    return table(spark, sf_dir, "customer").select("c_custkey", value("donation", _pick([s for s, _, _ in _DON], n)).alias("dollars"),
        value("newsletter", _pick(["News1", "News2"], n)).alias("newsletter"), value("trust_post_1", (n * 4).cast("string")).alias("slider"))


# --- Text ------------------------------------------------------------------------------------------------------------------

_S = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"



@query(f"""
SELECT doc_id, t IN ('', '[deleted]', '[removed]') AS gone, sha256(CASE WHEN length(s) > 80 THEN regexp_replace(substr(s, 1, 77), '{_S}+$', '') || '...' ELSE s END) AS short_sha,
  sha256(CASE WHEN p = '' THEN b ELSE '(Replying to another user''s comment: "' || CASE WHEN length(p) > 300 THEN substr(p, 1, 297) || '...' ELSE p END || '") ' || b END) AS reply_sha
FROM (SELECT doc_id, lower({_trim("x")}) AS t, {_trim("replace(x, chr(13), ' ')")} AS s, {_trim("x")} AS p, {_trim("source")} AS b
  FROM (SELECT doc_id, coalesce(source, '') AS source, CASE doc_id % 4 WHEN 0 THEN ' [deleted] ' WHEN 1 THEN '' ELSE coalesce(text, '') END AS x FROM documents))
""")
def removed_and_shortened(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("x", F.when(F.col("doc_id") % 4 == 0, " [deleted] ").when(F.col("doc_id") % 4 == 1, "").otherwise(X.blank("text")))
    return d.select("doc_id", X.removed("x").alias("gone"), F.sha2(X.shorten("x", 80), 256).alias("short_sha"), F.sha2(X.with_parent("source", "x"), 256).alias("reply_sha"))


_GOOD = '{"party": {"top_guess": "Other", "alternates": ["Democrat"], "confidence": %d}}'


@query("SELECT c_custkey, CASE WHEN c_nationkey * 5 <= 100 THEN CAST(c_nationkey * 5 AS BIGINT) END AS confidence FROM customer")
def last_valid_guess(spark, sf_dir):
    """The last object of a text that gives known levels, after one that doesn't."""
    ship(spark)
    said = F.concat(F.lit('I think {"party": 1} or rather {"party": {"top_guess": "Other", "alternates": ["Democrat"], "confidence": '), (F.col("c_nationkey") * 5).cast("string"), F.lit("}} {oops}"))
    got = A.last_valid_guess_udf({"party": vocab.MODERATORS["party"]})(said)
    return table(spark, sf_dir, "customer").select("c_custkey", F.get_json_object(got, "$.party.confidence").cast("bigint").alias("confidence"))


def _echo():
    """A client that answers with what stands behind ``ANSWER:`` in the prompt."""
    from ..operators.models import ChatResult, ModelError

    class Echo:
        model = provider = "echo"

        def chat(self, prompt, seed, temperature=None, system=None):
            text = prompt.partition("ANSWER:")[2].partition("\n\n")[0]
            if text == "down":
                raise ModelError("down")
            return ChatResult(text, "echo", "echo", len(prompt), len(text))

    return Echo()


@query("SELECT CAST(c_custkey AS VARCHAR) AS author, (['success', 'refusal', 'malformed_json', 'error'])[c_custkey % 4 + 1] AS status, CASE WHEN c_custkey % 4 = 0 THEN 'Other' END AS party, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 100 AS DOUBLE) END AS party_confidence FROM customer")
def inference_statuses(spark, sf_dir):
    ship(spark)
    k = F.col("c_custkey")
    good = F.concat(F.lit('{"party": {"top_guess": "Other", "alternates": [], "confidence": '), (k % 100).cast("string"), F.lit("}}"))
    said = F.when(k % 4 == 0, good).when(k % 4 == 1, "I cannot say").when(k % 4 == 2, "{}").otherwise("down")
    moulds = table(spark, sf_dir, "customer").select(k.cast("string").alias("author"), F.concat(F.lit("ANSWER:"), said).alias("mould"))
    made = survey.infer_attributes(moulds, _echo, levels={"party": vocab.MODERATORS["party"]})
    return made.select("author", "status", "party", "party_confidence")


@query("""
WITH c AS (SELECT c_custkey, (c_nationkey + 1) / 31.0::DOUBLE AS p, 0.5::DOUBLE AS q, 0.3::DOUBLE AS r FROM customer)
SELECT c_custkey, 72 AS sampled, CASE WHEN p >= 0.5 THEN 72 ELSE 12 END AS mode, round(p * (7 * 0.2 + 72 * q + 70 * r) + (1 - p) * (0.2 + 12 * q + 10 * r), 6) AS expected, round(1 - p, 6) AS borrowed FROM c
""")
def answer_distributions(spark, sf_dir):
    """The first digit is 7 or 1, by the nation; what follows is 2, 0 or the end."""
    ship(spark)
    p = (F.col("c_nationkey") + 1) / F.lit(31.0)
    text = F.lit("**title: TRUST_POST**\n**answer: 72**")
    number = lambda x: F.format_string("%.17f", F.log(x))
    top = lambda *pairs: F.concat(F.lit('"top_logprobs":['), F.concat_ws(",", *[F.concat(F.lit(f'{{"token":"{t}","logprob":'), number(x), F.lit("}")) for t, x in pairs]), F.lit("]"))
    stream = F.concat(
        F.lit('[{"token":"**title: TRUST_POST**\\n**answer: ","logprob":0},{"token":"7","logprob":-1,'), top(("7", p), ("1", 1 - p)), F.lit('},{"token":"2","logprob":-1,'),
        top(("2", F.lit(0.5)), ("0", F.lit(0.3)), ("**", F.lit(0.2))), F.lit('},{"token":"**","logprob":-0.01}]'))
    d = table(spark, sf_dir, "customer").select("c_custkey", A.dists_udf(["trust_post_1"])(text, stream).getItem("trust_post_1").alias("d"))
    return d.select("c_custkey", "d.sampled", "d.mode", rounded("d.expected").alias("expected"), rounded("d.borrowed").alias("borrowed"))


# --- People ---------------------------------------------------------------------------------------------------------------

def people(spark, sf_dir) -> DataFrame:
    """Customers as agents."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.format_string("agent_%04d", k).alias("profile_id"), F.concat(F.lit(" User_"), k.cast("string")).alias("author"), *[_pick(levels, k + i).alias(m) for i, (m, levels) in enumerate(_M.items())],
        _pick(["TX", "r/Maine", "nowhere", None], k).alias("assigned_state"), F.col("c_mktsegment").alias("segment"), F.when(k % 2 == 0, "x").otherwise("").alias("note"),
            F.when(k % 3 == 0, "1900").alias("year_birth"))


def posts(spark, sf_dir) -> DataFrame:
    """Orders as their customers' posts; one in seven without a text."""
    o = table(spark, sf_dir, "orders")
    post = F.struct(
        F.lit("comment").alias("type"), F.lower("o_orderstatus").alias("subreddit"),
            (F.lit(1_700_000_000) + F.col("o_orderkey") * 86_400).cast("string").alias("created_utc"), F.lit("").alias("title"),
        F.when(F.col("o_orderkey") % 7 == 0, "[removed]").otherwise(F.concat(F.lit("about "), "o_orderpriority")).alias("body"), F.lit("").alias("score"))
    return o.groupBy(F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("author")).agg(F.sort_array(F.collect_list(post)).alias("posts"))


_PEOPLE = f"""
WITH p AS (SELECT printf('agent_%04d', c_custkey) AS profile_id, ' User_' || c_custkey AS author, c_custkey, c_mktsegment, {", ".join(f"({_sql_list(levels)})[(c_custkey + {i}) % {len(levels)} + 1] AS {m}" for i, (m, levels) in enumerate(_M.items()))} FROM customer),
o AS (SELECT o_custkey, o_orderkey, lower(o_orderstatus) AS sub, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'about ' || o_orderpriority END AS body FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM o WHERE body <> ''),
l AS (SELECT *, '[' || n || '] ' || strftime(make_timestamp((1700000000 + o_orderkey * 86400) * 1000000), '%Y-%m-%d') || ' | comment in r/' || sub || ' | text: "' || body || '"' AS line FROM u),
g AS (SELECT o_custkey, sub, count(*) AS total, min(n) AS first FROM u GROUP BY 1, 2),
t AS (SELECT o_custkey, 'Most active subreddits (by number of posts and comments): ' || string_agg('r/' || sub || ' (' || total || ')', ', ' ORDER BY total DESC, first) AS top FROM g GROUP BY 1),
x AS (SELECT o_custkey, string_agg(line, chr(10) ORDER BY n) AS list, count(*) AS included FROM l WHERE n <= 60 GROUP BY 1),
w AS (SELECT o_custkey, count(*) AS usable FROM u GROUP BY 1), a AS (SELECT o_custkey, count(*) AS total FROM o GROUP BY 1)
"""


@query(_PEOPLE + """
SELECT profile_id, coalesce(included, 0) AS n_posts_included, CAST(coalesce(a.total, 0) AS INT) AS n_posts_total, sha256(CASE WHEN a.total IS NULL THEN '' ELSE coalesce(top || chr(10), '') END || 'Total posts and comments available: ' || coalesce(usable, 0) || chr(10) || chr(10)
  || 'Recent posts and comments written by this user (most recent first, up to 60 shown):' || chr(10) || coalesce(list, '(no post or comment text available for this user)')) AS profile_sha
FROM p LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN x ON x.o_custkey = c_custkey LEFT JOIN w ON w.o_custkey = c_custkey
""")
def persona_texts(spark, sf_dir):
    """What personas say of an author, newest first."""
    made = personas.build_personas(personas.check_agents(people(spark, sf_dir)), posts(spark, sf_dir))
    return made.select("profile_id", "n_posts_included", "n_posts_total", F.sha2("profile_text", 256).alias("profile_sha"))


@query(_PEOPLE + """
SELECT profile_id, author, gender, (['Texas', 'Maine', NULL, NULL])[c_custkey % 4 + 1] AS assigned_state, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS state_case,
  2026 - CASE age_band WHEN '18-29' THEN 24 WHEN '30-44' THEN 37 WHEN '45-59' THEN 52 ELSE CASE WHEN c_custkey % 3 = 0 THEN 126 ELSE 68 END END AS year_birth,
  'segment=' || c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS note FROM p
""")
def persona_records(spark, sf_dir):
    """A persona's levels, state, year of birth and further columns."""
    made = personas.build_personas(people(spark, sf_dir), posts(spark, sf_dir))
    return made.select("profile_id", "author", F.col("demographics.gender").alias("gender"), "assigned_state", "state_case", "year_birth",
        F.concat(F.lit("segment="), F.col("extra").getItem("segment")).alias("segment"), F.col("extra").getItem("note").alias("note"))


@query(_PEOPLE + "SELECT 'user_' || o_custkey AS author, count(*) AS n, sha256(string_agg(body, '|' ORDER BY o_orderkey)) AS bodies FROM o JOIN p ON o_custkey = c_custkey GROUP BY o_custkey")
def posts_of_agents(spark, sf_dir):
    """Interactions gathered for each agent, oldest first."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("USER_"), F.col("o_custkey").cast("string")).alias("author"), F.format_string("%012d", "o_orderkey").alias("created_utc"),
        F.lit("i").alias("id"), F.lit("s").alias("subreddit"), F.lit("").alias("parent_body"),
                    F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("about "), "o_orderpriority")).alias("body"))
    made = personas.persona_posts(people(spark, sf_dir), rows)
    return made.select("author", F.size("posts").cast("bigint").alias("n"), F.sha2(F.array_join(F.transform("posts", lambda x: x["body"]), "|"), 256).alias("bodies"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ids_that_are_missing(spark, sf_dir):
    return budget.missing_ids(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT n_posts, agents FROM (SELECT CASE WHEN n <= 12 THEN n END AS n_posts, count(*) AS agents FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1)")
def coverage_histogram(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return interactions.coverage_histogram(interactions.coverage(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey"), 12)


@query("SELECT conv_id || '_' || turn AS id, CASE turn WHEN 0 THEN 'submission' WHEN 1 THEN 'first_level_comment' WHEN 2 THEN 'reply_depth2' ELSE 'reply_deeper' END AS structure_kind FROM conversations WHERE role = 'assistant'")
def threads_of_some_authors(spark, sf_dir):
    """Only some authors' rows are classified, while parents are looked for among all."""
    from .catalog import whole_threads

    who = spark.createDataFrame([(" ASSISTANT ",)], "author string")
    return threads.classify(whole_threads(spark, sf_dir), authors=who).select("id", "structure_kind")


@query("SELECT DISTINCT 'unknown ' || o_orderstatus AS label FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'both ' || x FROM (SELECT DISTINCT o_orderstatus AS x FROM orders INTERSECT SELECT 'F')")
def label_sets(spark, sf_dir):
    """Labels beyond the known ones, and those that two tables share."""
    o = table(spark, sf_dir, "orders")
    odd = validate.unknown_labels(o, "o_orderstatus", ["F", "O"]).select(F.concat(F.lit("unknown "), "label").alias("label"))
    known = spark.createDataFrame([("F",), ("Z",)], "label string")
    return odd.unionByName(o.select(F.col("o_orderstatus").alias("label")).intersect(known).select(F.concat(F.lit("both "), "label").alias("label")))


@query("""
WITH a AS (SELECT 'segment' AS variable, c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 2), t AS (SELECT * FROM (VALUES ('segment', 'BUILDING', 0.25), ('segment', 'NONE', 0.75)) v(variable, category, target))
SELECT coalesce(a.variable, t.variable) AS variable, coalesce(a.category, t.category) AS category, round(n / (SELECT sum(n) FROM a), 9) AS achieved, CAST(target AS DOUBLE) AS target FROM a FULL JOIN t ON a.variable = t.variable AND a.category = t.category
""")
def achieved_margins(spark, sf_dir):
    targets = spark.createDataFrame([("segment", "BUILDING", 0.25), ("segment", "NONE", 0.75)], "variable string, category string, share double")
    made = sampling.achieved_margins(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")), targets, ["segment"])
    return made.select("variable", "category", F.round("achieved", 9).alias("achieved"), "target")


# --- Sessions --------------------------------------------------------------------------------------------------------------

_SEED = "CAST(('0x' || right(sha256('7||' || profile_id || '||' || c.condition || '||'), 8)) AS BIGINT)"
_CODE = {t: c for c, t in vocab.CODENAMES.items() if t != vocab.CONTROL}
_PLAN = f"""
WITH p AS (SELECT printf('agent_%04d', c_custkey) AS profile_id FROM customer),
d AS (SELECT * FROM (VALUES {sql_values([(c, _CODE.get(c), {"Funding": 4, "Consensus": 4, "High public trust": 2}.get(c, 1), 44 + {"Funding": 7, "Consensus": 3, "High public trust": 1}.get(c, 0)) for c in vocab.CONDITIONS])}) v(condition, code, steps, items)),
s AS (SELECT profile_id, c.*, {_SEED} AS seed FROM p, d c)
"""


@query(_PLAN + f"SELECT profile_id, condition, seed, coalesce(code, ({_sql_list(vocab.CONTROL_FILLERS)})[seed % 3 + 1]) AS codename, CAST(steps AS BIGINT) AS steps, CAST(items AS BIGINT) AS items FROM s")
def session_sizes(spark, sf_dir):
    """Every agent in every condition: the code name drawn, steps and items."""
    plan = session.session_plan(people(spark, sf_dir))
    return plan.groupBy("profile_id", "condition", "seed", "codename").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.size("items")).cast("bigint").alias("items"))


_ORDER = "list_transform(list_sort(list_transform({}, lambda k: {{'h': sha256(seed || '|' || k), 'k': k}})), lambda x: x.k)"


@query(_PLAN + f"""
SELECT profile_id, condition, array_to_string({_ORDER.format("['human', 'co2', 'year']")}, ',') AS statements, array_to_string({_ORDER.format(_sql_list([k for g, k, _ in vocab.BLOCKS if g == 2]))}, ',') AS second,
  array_to_string({_ORDER.format(_sql_list([k for g, k, _ in vocab.BLOCKS if g == 3]))}, ',') AS third FROM s WHERE condition = 'Consensus'
""")
def session_orders(spark, sf_dir):
    """Random orders of statements and blocks, as sessions meet them."""
    plan = session.session_plan(people(spark, sf_dir), conditions=["Consensus"]).withColumn("item", F.explode("items"))
    block = R.code_map("item", {i: k for _, k, items in vocab.BLOCKS for i in items})
    group = R.code_map("item", {i: g for g, _, items in vocab.BLOCKS for i in items})
    place = F.struct("step", F.array_position("items", F.col("item")).alias("at"))
    w = Window.partitionBy("profile_id", "condition", "what")
    what = F.when(F.startswith("item", F.lit("consensus_")), "statements").when(group == 2, "second").when(group == 3, "third")
    named = plan.select("profile_id", "condition", what.alias("what"), F.coalesce(block, F.replace("item", F.lit("consensus_"), F.lit(""))).alias("name"),
        place.alias("place")).where("what IS NOT NULL")
    first = named.groupBy("profile_id", "condition", "what", "name").agg(F.min("place").alias("place"))
    told = first.groupBy("profile_id", "condition").pivot("what", ["statements", "second", "third"]).agg(F.sort_array(F.collect_list(F.struct("place", "name"))))
    return told.select("profile_id", "condition", *[F.array_join(F.transform(c, lambda x: x["name"]), ",").alias(c) for c in ("statements", "second", "third")])


_BLOCK_PARTS = "MAP {" + ", ".join(f"'{k}': {_sql_list(([f'p:{k}:pre_page'] if k in vocab.PRE_PAGES else []) + [f'i:{i}' for i in items])}" for _, k, items in vocab.BLOCKS) + "}"
_SCRIPTS = ", ".join(f"('{c}', {'NULL' if c not in _CODE else chr(39) + _CODE[c] + chr(39)}, [{', '.join(_sql_list(x) for x in session.SCRIPTS[c])}])" for c in vocab.CONDITIONS)
_FILLED = "list_transform(script[n], lambda e: replace(replace(replace(replace(replace(e, '{filler}', replace(codename, ' ', '_')), '{case}', state_case), '{c1}', cs[1]), '{c2}', cs[2]), '{c3}', cs[3]))"


_STEPS = f"""
WITH p AS (SELECT printf('agent_%04d', c_custkey) AS profile_id, c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE '4' END AS state_case FROM customer), d AS (SELECT * FROM (VALUES {_SCRIPTS}) v(condition, code, script)),
s AS (SELECT profile_id, c_custkey, state_case, c.*, {_SEED} AS seed FROM p, d c),
o AS (SELECT *, coalesce(code, ({_sql_list(vocab.CONTROL_FILLERS)})[seed % 3 + 1]) AS codename, {_ORDER.format("['human', 'co2', 'year']")} AS cs, unnest(range(1, len(script) + 1)) AS n,
  list_concat(['trust_multidimensional'], {_ORDER.format(_sql_list([k for g, k, _ in vocab.BLOCKS if g == 2]))}, {_ORDER.format(_sql_list([k for g, k, _ in vocab.BLOCKS if g == 3]))}) AS blocks FROM s),
e AS (SELECT *, list_concat({_FILLED}, CASE WHEN n < len(script) THEN [] ELSE list_concat(['p:transition_treatment_to_post'], flatten(list_transform(blocks, lambda k: {_BLOCK_PARTS}[k]))) END) AS elements FROM o)
"""


@query(_STEPS + """
SELECT profile_id, condition, codename, seed, CAST(n - 1 AS INT) AS step, CASE WHEN n < len(script) THEN 'treatment_' || n WHEN n > 1 THEN 'treatment_' || n || '+battery' ELSE 'battery' END AS step_name, array_to_string(elements, ';') AS elements FROM e
""")
def session_plan(spark, sf_dir):
    """Every step of every session: what each agent meets, in order."""
    made = personas.build_personas(people(spark, sf_dir), posts(spark, sf_dir))
    return session.session_plan(made).select("profile_id", "condition", "codename", "seed", "step", "step_name", F.array_join("elements", ";").alias("elements"))


_KEYS = [*vocab.ITEM_KEYS, *vocab.ELICITATION_ITEMS]
_BYTE = "CAST('0x' || substr(h, {}, 2) AS INT)"
#: What the stand-in answers: a hash of the step's seed and the title.
_ANSWERED = _STEPS + f"""
, i AS (SELECT profile_id, c_custkey, condition, codename, n, unnest(list_transform(list_filter(elements, lambda x: starts_with(x, 'i:')), lambda x: substr(x, 3))) AS key FROM e),
v AS (SELECT * FROM (VALUES {sql_values([(k, vocab.title(k), {"donation": "Don", "newsletter": "News"}.get(k)) for k in _KEYS])}) v(key, title, choice)),
w AS (SELECT i.*, choice, sha256(CAST(('0x' || right(sha256('7||' || profile_id || '||' || condition || '||' || (n - 1) || ':1'), 8)) AS BIGINT) || '/' || title) AS h FROM i JOIN v USING (key)),
a AS (SELECT *, CASE choice WHEN 'Don' THEN 'Don' || {_BYTE.format(1)} % 11 WHEN 'News' THEN 'News' || ({_BYTE.format(1)} % 2 + 1) ELSE CAST({_BYTE.format(3)} % 51 + {_BYTE.format(5)} % 51 AS VARCHAR) END AS answer FROM w)
"""


def _surveyed(spark, sf_dir, *columns: str) -> DataFrame:
    """All agents in all conditions, answered by the stand-in."""
    ship(spark)
    made = personas.build_personas(people(spark, sf_dir), posts(spark, sf_dir))
    return survey.run_survey(made, survey.DummyClient, survey.RunOptions(), columns=["profile_id", "condition", "status", *columns])


@query(_ANSWERED + """
SELECT profile_id, condition, 'complete' AS status, CAST(max(n) AS INT) AS n_steps, CAST(max(n) AS INT) AS n_calls, CAST(count(*) AS INT) AS n_answers, '{' || string_agg('"' || key || '":"' || answer || '"', ',' ORDER BY key) || '}' AS answers FROM a GROUP BY 1, 2
""")
def dummy_survey(spark, sf_dir):
    answers = F.to_json(F.map_from_entries(F.sort_array(F.map_entries("answers"))))
    return _surveyed(spark, sf_dir, "n_steps", "n_calls", "answers").select("profile_id", "condition", "status", "n_steps", "n_calls", F.size("answers").alias("n_answers"), answers.alias("answers"))


@query(_PLAN + "SELECT profile_id, array_to_string(list_transform(list_sort(list_transform(['belief_pre', 'trust_pre'], lambda k: {'h': sha256(CAST(('0x' || right(sha256('7||' || profile_id || '||__pretreatment__||'), 8)) AS BIGINT) || '|' || k), 'k': k})), lambda x: x.k), ',') AS items FROM p")
def pretreatment_orders(spark, sf_dir):
    return session.pretreatment_plan(people(spark, sf_dir)).select("profile_id", F.array_join("items", ",").alias("items"))


@query("SELECT count(*) AS calls, count(*) FILTER (WHERE turn % 3 = 0) AS failures, CAST(sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE length(coalesce(text, '')) END) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cached_tokens FROM conversations")
def call_totals(spark, sf_dir):
    """Calls, tokens and failures of sessions and of what was asked before them."""
    t = table(spark, sf_dir, "conversations")
    failed = F.col("turn") % 3 == 0
    call = F.struct(F.when(failed, "down").alias("error"), F.when(failed, 0).otherwise(F.length(X.blank("text"))).cast("bigint").alias("input_tokens"),
        F.col("turn").cast("bigint").alias("output_tokens"), F.lit(0).cast("bigint").alias("cached_tokens"))
    of = lambda rows, *more: rows.groupBy(F.col("conv_id").cast("string").alias("profile_id"), *more).agg(F.collect_list(call).alias("calls"))
    return survey.usage(of(t.where("turn > 0"), F.col("role").alias("condition")), of(t.where("turn = 0")))


@query()
def survey_prompts(spark, sf_dir):
    """Prompts of one session, by their step."""
    who = personas.build_personas(people(spark, sf_dir), posts(spark, sf_dir))
    first = who.agg(F.min("profile_id")).first()[0]
    return spark.createDataFrame([(i, n, len(p)) for i, (n, p) in enumerate(survey.prompts_of(who, first, "Funding"))], "step int, name string, chars int")
