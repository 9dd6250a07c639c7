"""Where a comment stands in its thread, from parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_PARENT = ["author", "created_utc", "body", "parent_id"]


def classify(history: DataFrame, external: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """history with ``parent_body, parent_author, parent_created_utc, structure_kind``.

    A comment on a submission is a first-level comment; a reply to one of those has depth 2; a reply to
    a deeper one is deeper; a reply whose parent is in neither table is unresolved.  Own rows come before external ones, the first
    of repeated ids counts.  authors limits what is classified, not where parents are looked for."""
    texts = [X.blank(c).alias(c) for c in _PARENT]
    own = history.select(X.bare_id("id").alias("_pid"), *texts, F.lit(0).alias("_source"))
    if external is not None:
        own = own.unionByName(external.select(X.bare_id("id").alias("_pid"), *texts, F.lit(1).alias("_source")))
    # The first row of each id, combined in every task before anything is exchanged.
    place = F.struct("_source", "created_utc", "parent_id", "author", "body")
    parents = own.where("_pid IS NOT NULL").groupBy("_pid").agg(F.min(place).alias("_p")).select("_pid", *[F.col(f"_p.{c}").alias(f"_p_{c}") for c in _PARENT])
    rows = history if authors is None else history.join(authors.select(X.key("author").alias("_a")).distinct(), X.key("author") == F.col("_a"), "left_semi")
    is_reply = (F.col("post_type") == "comment") & F.startswith(X.blank("parent_id"), F.lit("t1_"))
    # Only replies have a parent to find; all else stays where it is.
    replies = rows.where(F.coalesce(is_reply, F.lit(False))).withColumn("_pid", X.bare_id("parent_id")).join(parents, "_pid", "left").drop("_pid")
    others = rows.where(~F.coalesce(is_reply, F.lit(False))).withColumns({f"_p_{c}": F.lit(None).cast("string") for c in _PARENT})
    joined = replies.unionByName(others)
    found = F.col("_p_parent_id").isNotNull()
    kind = (F.when(F.col("post_type") == "submission", "submission").when(F.startswith(X.blank("parent_id"), F.lit("t3_")), "first_level_comment")
            .when(is_reply & found & F.startswith(F.col("_p_parent_id"), F.lit("t3_")), "reply_depth2").when(is_reply & found, "reply_deeper").otherwise("unresolved"))
    return joined.withColumns({"structure_kind": kind, **{f"parent_{c}": X.blank(f"_p_{c}") for c in ("body", "author", "created_utc")}}).drop(*[f"_p_{c}" for c in _PARENT])


def missing_parents(classified: DataFrame) -> DataFrame:
    """Bare ids of parents that no table held, in order."""
    return classified.where((F.col("structure_kind") == "unresolved") & F.startswith(X.blank("parent_id"),
        F.lit("t1_"))).select(X.bare_id("parent_id").alias("id")).where("id IS NOT NULL").distinct().orderBy("id")
