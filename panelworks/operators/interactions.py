"""Replies that say something to the person they answer, by length and linguistic cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

COLUMNS = ["author", "id", "subreddit", "created_utc", "body", "word_count", "parent_author", "parent_body", "matched_cues"]


def meaningful(classified: DataFrame, relaxed: DataFrame | None = None, min_words: int = 10, ascii_words: bool = False) -> DataFrame:
    """Depth-2 replies of enough words with a cue or a quotation.  relaxed (``author[, min_words]``): for those authors a lower floor
    that needs no cue; such rows are tagged ``relaxed_min_words:N``.  ascii_words: as in text.cues."""
    rows = classified.where(F.col("structure_kind") == "reply_depth2").withColumn("word_count", X.word_count("body"))
    if relaxed is None:
        rows = rows.where(F.col("word_count") >= min_words)
    rows = rows.withColumns({"_cues": X.cues("body", ascii_words), "_quoted": X.quotes("body", "parent_body")})
    rows = rows.withColumn("_cues", F.concat("_cues", F.when(F.col("_quoted"), F.array(F.lit("quotation"))).otherwise(F.array().cast("array<string>"))))
    ok = (F.col("word_count") >= min_words) & (F.size("_cues") > 0)
    if relaxed is not None:
        floor = F.col("min_words").try_cast("int") if "min_words" in relaxed.columns else F.lit(None).cast("int")
        floors = relaxed.select(X.key("author").alias("_a"), F.coalesce(floor, F.lit(min_words)).alias("_floor")).groupBy("_a").agg(F.min("_floor").alias("_floor"))
        rows = rows.join(floors, X.key("author") == F.col("_a"), "left").drop("_a")
        low = ~ok & (F.col("word_count") >= F.col("_floor"))
        rows = rows.withColumn("_cues", F.when(F.coalesce(low, F.lit(False)), F.concat("_cues", F.array(F.concat(F.lit("relaxed_min_words:"),
            F.col("_floor").cast("string"))))).otherwise(F.col("_cues")))
        ok = ok | F.coalesce(F.col("word_count") >= F.col("_floor"), F.lit(False))
    return rows.where(ok).withColumn("matched_cues", F.array_join("_cues", ";")).select(*COLUMNS)


def pending_fetch(classified: DataFrame, min_words: int = 10, ascii_words: bool = False) -> DataFrame:
    """Unresolved replies to comments whose own words already qualify: their parents are worth fetching."""
    rows = classified.where((F.col("structure_kind") == "unresolved") & F.startswith(X.blank("parent_id"), F.lit("t1_"))).withColumn("_cues", X.cues("body", ascii_words))
    return rows.where((X.word_count("body") >= min_words) & (F.size("_cues") > 0)).select(
        F.col("id").alias("reply_id"), F.col("author").alias("reply_author"), X.bare_id("parent_id", "1").alias("parent_bare_id"), F.array_join("_cues", ";").alias("matched_cues_own_text_only"))


def cue_frequency(interactions: DataFrame) -> DataFrame:
    return interactions.select(F.explode(F.split("matched_cues", ";")).alias("cue")).where("cue <> ''").groupBy("cue").agg(F.count(F.lit(1)).alias("n"))


def coverage(agents: DataFrame, posts: DataFrame, key: str = "author") -> DataFrame:
    """How many posts each agent has; none is 0."""
    counts = posts.groupBy(X.key(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return agents.withColumn("_k", X.key(key)).join(counts, "_k", "left").withColumn("n_posts", F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def coverage_histogram(covered: DataFrame, cap: int = 20, column: str = "n_posts") -> DataFrame:
    """``n_posts, agents``: how many agents have each number of posts; those above the cap together, as null."""
    return covered.groupBy(F.when(F.col(column) <= cap, F.col(column)).alias(column)).agg(F.count(F.lit(1)).alias("agents"))


def coverage_stats(covered: DataFrame, thresholds: tuple = (1, 3, 5, 10), column: str = "n_posts") -> DataFrame:
    return covered.agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.median(column).alias("median"), F.min(column).alias("least"),
        F.max(column).alias("most"), *[F.count_if(F.col(column) < t).alias(f"below_{t}") for t in thresholds])
