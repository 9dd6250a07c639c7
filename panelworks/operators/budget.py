"""Prefixes under a budget, and top-n per group, by running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(df: DataFrame, group: Sequence[str], order: Sequence, cost: str, budget: int, max_rows: int | None = None) -> DataFrame:
    """Rows of each group in order while the costs so far fit the budget; the first always stays, and the first that overflows
    ends it.  Adds ``position`` and ``used``."""
    w = Window.partitionBy(*group).orderBy(*order)
    made = df.withColumns({"position": F.row_number().over(w), "used": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    # Costs are not negative, so the running sum only grows and one test per row is the whole rule.
    kept = made.where((F.col("position") == 1) | (F.col("used") <= budget))
    return kept if max_rows is None else kept.where(F.col("position") <= max_rows)


def top_n(df: DataFrame, group: Sequence[str], order: Sequence, n: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= n)


def latest_best(df: DataFrame, pair: Sequence[str], rank, seq: str) -> DataFrame:
    """Per pair the row of best rank, the last among equals; ``first_seen`` gives the order of first appearance.  An aggregate, so
    tasks combine what they have and a pair of very many rows isn't sorted in one place."""
    rest = [c for c in df.columns if c not in pair]
    best = df.groupBy(*pair).agg(F.max_by(F.struct(*rest), F.struct(rank.alias("rank"), F.col(seq).alias("seq"))).alias("_best"), F.min(seq).alias("first_seen"))
    return best.select(*[c if c in pair else F.col("_best").getField(c).alias(c) for c in df.columns], "first_seen")


def status_rank(status: str = "status"):
    return F.when(F.col(status) == "complete", 2).when(F.col(status) == "partial", 1).otherwise(0)


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is left of todo after what is done: for resuming."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def missing_ids(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return not_done(wanted, have, [key]).select(key).distinct()
