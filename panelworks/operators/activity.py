"""Activity per author and community, the state it points to, and community scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.recode import number


def activity_counts(history: DataFrame, author: str = "author", group: str = "subreddit") -> DataFrame:
    """``author, <group>, total``; blank authors and groups go."""
    keyed = history.select(X.key(author).alias(author), X.key(group).alias(group)).where(f"`{author}` <> '' AND `{group}` <> ''")
    return keyed.groupBy(author, group).agg(F.count(F.lit(1)).alias("total"))


def activity_map(counts: DataFrame, author: str = "author", group: str = "subreddit") -> DataFrame:
    """One row per author with a map of group to ``{total}``."""
    entry = F.struct(F.col(group), F.struct(F.col("total")).alias("v"))
    return counts.groupBy(author).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(f"{group}_activity"))


def explode_map(activity: DataFrame, author: str = "author", group: str = "subreddit") -> DataFrame:
    return activity.select(author, F.explode(f"{group}_activity").alias(group, "_v")).select(author, group, F.col("_v.total").alias("total"))


def unambiguous(lookup: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that lead to one value only."""
    return lookup.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")


def top_group(totals: DataFrame, author: str, group: str, total: str = "total") -> DataFrame:
    """Each author's largest group (ties: the first by name), its total, how many groups there are, and whether it was tied."""
    by_author = Window.partitionBy(author)
    ranked = totals.withColumns({
        "_row": F.row_number().over(by_author.orderBy(F.desc(total), F.asc(group))),
        "n_groups": F.count(F.lit(1)).over(by_author),
        "_top": F.max(total).over(by_author),
    }).withColumn("tied", F.count_if(F.col(total) == F.col("_top")).over(by_author) > 1)
    return ranked.where("_row = 1").select(author, group, total, "n_groups", "tied")


def assign_state(counts: DataFrame, states: DataFrame) -> DataFrame:
    """``author, assigned_state, state_post_count, n_states_matched, tied`` from community counts and ``state, subreddit``."""
    lookup = states.select(X.key("state").alias("state"), F.lower(X.without_r(X.strip("subreddit"))).alias("subreddit")).where("subreddit <> ''")
    known = counts.select(X.key("author").alias("author"), F.lower(X.without_r(X.strip("subreddit"))).alias("subreddit"), F.col("total").cast("bigint").alias("total"))
    by_state = known.join(unambiguous(lookup, "subreddit", "state"), "subreddit").groupBy("author", "state").agg(F.sum("total").alias("total"))
    return top_group(by_state, "author", "state").select("author", F.col("state").alias("assigned_state"), F.col("total").alias("state_post_count"),
        F.col("n_groups").alias("n_states_matched"), "tied")


def backfill(rows: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the column taken from fresh where it has the key, else as it was, else blank."""
    new = fresh.select(X.key(key).alias("_key"), F.col(column).alias("_new"))
    old = F.col(column) if column in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("_key", X.key(key)).join(new, "_key", "left").withColumn(column, F.coalesce("_new", old, F.lit(""))).drop("_key", "_new")


def weighted_scores(counts: DataFrame, scores: DataFrame, key: str, author: str, total: str, dims: Sequence[str]) -> DataFrame:
    """Per author the mean of each score weighted by totals (null without overlap), and how many groups there are and are scored.  A
    score that is not a number counts as missing."""
    known = scores.select(key, *[number(d).alias(d) for d in dims], F.lit(True).alias("_scored"))
    joined = counts.join(known, key, "left")
    mean = lambda d: (F.sum(F.col(total) * F.col(d)) / F.nullif(F.sum(F.when(F.col(d).isNotNull(), F.col(total))), F.lit(0))).alias(f"{d}_score")
    return joined.groupBy(author).agg(*[mean(d) for d in dims], F.count(F.lit(1)).alias("n_total"), F.count_if("_scored").alias("n_scored"))
