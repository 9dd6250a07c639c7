"""Personas: an agent's levels, and a dated list of the author's own words under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recode as R
from ..functions import text as X
from ..functions import vocab
from .activity import top_group  # noqa: F401  (part of this module's surface for callers that rank groups)

POST = "struct<type:string,subreddit:string,created_utc:string,title:string,body:string,score:string>"


def persona_posts(agents: DataFrame, interactions: DataFrame) -> DataFrame:
    """``author, posts`` of agents' interactions, oldest id order kept as given by ``created_utc`` and ``id``."""
    chosen = agents.select(X.key("author").alias("author")).distinct()
    rows = interactions.withColumn("author", X.key("author")).join(chosen, "author", "left_semi")
    post = F.struct(F.lit("comment").alias("type"), X.blank("subreddit").alias("subreddit"), X.blank("created_utc").alias("created_utc"), F.lit("").alias("title"),
        X.with_parent("body", "parent_body").alias("body"), F.lit("").alias("score"))
    ordered = F.sort_array(F.collect_list(F.struct(X.blank("created_utc").alias("t"), X.blank("id").alias("i"), post.alias("post"))))
    return rows.groupBy("author").agg(F.transform(ordered, lambda x: x["post"]).alias("posts"))


def without_posts(agents: DataFrame, posts: DataFrame) -> int:
    return agents.select(X.key("author").alias("author")).distinct().join(posts, "author", "left_anti").count()


def agent_faults(agents: DataFrame) -> DataFrame:
    """One row: how many agents have a level that is not known, by variable, and how many ids are ``repeated ids``."""
    known = [m for m in vocab.MODERATORS if m in agents.columns]
    return agents.select(*[F.count_if(~F.coalesce(F.col(m).isin(vocab.MODERATORS[m]), F.lit(False))).alias(m) for m in known],
        (F.count(F.lit(1)) - F.count_distinct("profile_id")).alias("repeated ids"))


def check_agents(agents: DataFrame) -> DataFrame:
    """Agents as they came; an error where a level is unknown or a profile id repeats."""
    wrong = {k: v for k, v in agent_faults(agents).first().asDict().items() if v}
    if wrong:
        raise ValueError(f"agents with unknown levels or repeated ids: {wrong}")
    return agents


def with_background(moulds: DataFrame, scores: DataFrame) -> DataFrame:
    """``author, mould`` with ``background``: lines on the author's scores, blank where there are none."""
    lines = scores.select("author", X.background("ideology_score", "gender_score", "age_score").alias("background"))
    return moulds.join(lines, "author", "left").withColumn("background", F.coalesce("background", F.lit("")))


def verbalize(posts: DataFrame, max_posts: int = 60, max_chars_per_post: int = 600, max_total_chars: int = 16_000, top: int = 15, activity: DataFrame | None = None) -> DataFrame:
    """``author, profile_text, n_posts_included, n_posts_total`` from ``author, posts``.

    Newest first; each entry carries its number, so entries are numbered, rendered and then cut by a running sum of
    their lengths: the first always stays, the first that overflows ends the list."""
    rows = posts.select("author", F.posexplode_outer("posts").alias("seq", "p"))
    body, ttl = F.coalesce(F.nullif(F.col("p.body"), F.lit("")), F.lit("")), X.blank("p.title")
    usable = F.col("p").isNotNull() & ~(X.removed(body) & X.removed(ttl))
    when = F.coalesce(F.col("p.created_utc").cast("string").try_cast("double"), F.lit(0.0))
    latest = Window.partitionBy("author").orderBy(F.desc("_ts"), "seq")
    # The layout of the list.
    used = rows.where(usable).select("author", "seq", "p", when.alias("_ts")).withColumn("n", F.row_number().over(latest))
    sub = F.coalesce(F.nullif(X.blank("p.subreddit"), F.lit("")), F.lit("unknown"))
    kind = F.lower(F.coalesce(F.nullif(X.blank("p.type"), F.lit("")), F.when(X.blank("p.title") != "", "submission").otherwise("comment")))
    text, short = X.shorten("p.body", max_chars_per_post), X.shorten("p.title", 300)
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), X.day("p.created_utc"))
    post_line = F.concat(head, F.lit(" | post in r/"), sub, F.lit(" | title: \""), short, F.lit("\""), F.when(X.removed(text), "").otherwise(F.concat(F.lit(" | text: \""), text, F.lit("\""))))
    line = F.when(kind.isin("submission", "post", "s"), post_line).otherwise(F.concat(head, F.lit(" | comment in r/"), sub, F.lit(" | text: \""), text, F.lit("\"")))
    lines = used.withColumns({"line": line, "sub": sub}).withColumn("chars", F.sum(F.length("line")).over(latest.rowsBetween(Window.unboundedPreceding, 0)))
    kept = lines.where((F.col("n") <= max_posts) & ((F.col("n") == 1) | (F.col("chars") <= max_total_chars)))
    listed = kept.groupBy("author").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("_list"),
        F.count(F.lit(1)).alias("n_posts_included"))
    if activity is None:
        groups = lines.groupBy("author", "sub").agg(F.count(F.lit(1)).alias("total"), F.min("n").alias("first"))
    else:  # author, subreddit, total
        groups = activity.select("author", F.col("subreddit").alias("sub"), "total").withColumn("first", F.row_number().over(Window.partitionBy("author").orderBy("sub")))
    best = groups.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("total"), "first"))).where(F.col("r") <= top)
    named = F.transform(F.sort_array(F.collect_list(F.struct("r", F.format_string("r/%s (%d)", F.col("sub"), F.col("total")).alias("s")))), lambda x: x["s"])
    best = best.groupBy("author").agg(F.concat(F.lit("Most active subreddits (by number of posts and comments): "), F.array_join(named, ", ")).alias("_top"))
    totals = used.groupBy("author").agg(F.count(F.lit(1)).alias("_usable"))
    out = posts.select("author", F.size("posts").alias("n_posts_total")).join(totals, "author", "left").join(best, "author", "left").join(listed, "author", "left")
    body_text = F.concat_ws("\n", "_top", F.concat(F.lit("Total posts and comments available: "), F.coalesce("_usable", F.lit(0)).cast("string")), F.lit(""),
                            F.lit(f"Recent posts and comments written by this user (most recent first, up to {max_posts} shown):"),
                                F.coalesce("_list", F.lit("(no post or comment text available for this user)")))
    return out.select("author", body_text.alias("profile_text"), F.coalesce("n_posts_included", F.lit(0)).alias("n_posts_included"), F.greatest("n_posts_total", F.lit(0)).alias("n_posts_total"))


_NO_TEXT = "Total posts and comments available: 0\n\nRecent posts and comments written by this user (most recent first, up to {} shown):\n(no post or comment text available for this user)"


def build_personas(agents: DataFrame, posts: DataFrame, max_posts: int = 60, max_chars_per_post: int = 600, max_total_chars: int = 16_000) -> DataFrame:
    """One persona per agent.  Posts are found by author, else by profile id."""
    texts = verbalize(posts.withColumn("author", X.key("author")), max_posts, max_chars_per_post, max_total_chars)
    by = lambda n: texts.select(F.col("author").alias(f"_{n}"), F.struct("profile_text", "n_posts_included", "n_posts_total").alias(f"_h{n}"))
    column = lambda n: F.col(n) if n in agents.columns else F.lit(None).cast("string")
    rows = agents.withColumns({"_a": X.key("author") if "author" in agents.columns else F.lit(""), "_p": X.key("profile_id")})
    rows = rows.join(by(1), F.col("_a") == F.col("_1"), "left").join(by(2), F.col("_p") == F.col("_2"), "left").withColumn("_h", F.coalesce("_h1", "_h2"))
    state = R.state(column("assigned_state"))
    fixed = {*vocab.MODERATORS, "profile_id", "author", "author_key", "assigned_state", "_a", "_p", "_h", "_1", "_2", "_h1", "_h2"}
    others = [c for c in agents.columns if c not in fixed]
    extra = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[X.blank(c) for c in others])), lambda _, v: v != "") if others else F.create_map().cast("map<string,string>")
    return rows.select(
        "profile_id", column("author").alias("author"), F.struct(*vocab.MODERATORS).alias("demographics"), state.alias("assigned_state"), R.state_case(column("assigned_state")).alias("state_case"),
        R.resolved_birth_year(column("year_birth"), column("birth_year"), column("age"), F.col("age_band")).alias("year_birth"),
        F.coalesce("_h.profile_text", F.lit(_NO_TEXT.format(max_posts))).alias("profile_text"), F.coalesce("_h.n_posts_included", F.lit(0)).alias("n_posts_included"),
            F.coalesce("_h.n_posts_total", F.lit(0)).alias("n_posts_total"), extra.alias("extra"))


def author_mould(history: DataFrame, max_tokens: int = 3000, seq: str = "seq") -> DataFrame:
    """``author, mould, n_records``: each author's newest records under a token budget, told oldest first."""
    from .budget import budget_prefix

    rows = history.withColumns({"_t": X.epoch("created_utc"), "_text": X.record_text("title", "body")}).where("_t IS NOT NULL AND _text <> ''")
    rows = rows.withColumns({"_cost": X.token_estimate("_text"), "_line": X.mould_line("created_utc", "subreddit", "title", "body")})
    kept = budget_prefix(rows, ["author"], [F.desc("_t"), F.col(seq)], "_cost", max_tokens)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_t", F.col(seq).alias("s"), "_line"))), lambda x: x["_line"])
    return kept.groupBy("author").agg(F.array_join(lines, "\n").alias("mould"), F.count(F.lit(1)).alias("n_records"))
