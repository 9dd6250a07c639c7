"""Weighted shares of survey microdata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_marginals(df: DataFrame, variables: Sequence[str], weight: str) -> DataFrame:
    """``variable, category, weighted_share``: shares of each variable among rows where it is known."""
    long = df.select(F.col(weight).alias("_w"), *[F.col(v).cast("string").alias(v) for v in variables]).unpivot(["_w"], list(variables), "variable", "category").where("category IS NOT NULL")
    sums = long.groupBy("variable", "category").agg(F.sum("_w").alias("_s"))
    return sums.withColumn("weighted_share", F.col("_s") / F.sum("_s").over(Window.partitionBy("variable"))).drop("_s")


def weighted_crosstab(df: DataFrame, variables: Sequence[str], weight: str) -> DataFrame:
    """Share of each combination among rows where all variables are known."""
    known = df.dropna(subset=list(variables)).groupBy(*variables).agg(F.sum(weight).alias("_s"))
    return known.withColumn("weighted_share", F.col("_s") / F.sum("_s").over(Window.partitionBy())).drop("_s")


def sparse_cells(crosstab: DataFrame, below: float = 0.001) -> DataFrame:
    return crosstab.agg(F.count_if(F.col("weighted_share") < below).alias("sparse"), F.count(F.lit(1)).alias("cells"))


def value_counts(df: DataFrame, column: str, known: Sequence[str] | None = None) -> DataFrame:
    """``value, n, share``; what is blank or not among the known values as "(other/blank)"."""
    v = F.col(column).cast("string")
    v = F.when(v.isNull() | (v == ""), "(other/blank)").otherwise(v) if known is None else F.when(v.isin(list(known)), v).otherwise("(other/blank)")
    counts = df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
