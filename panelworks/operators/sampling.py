"""Quota sampling: targets by largest remainders, seeded draws per cell, redistribution of shortfalls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..scratch import written

CELL = ["gender", "age_band", "race"]


def apportion(df: DataFrame, group: Sequence[str], weight: str, seats, order: Sequence, out: str = "seats") -> DataFrame:
    """Whole seats in proportion to weights, summing to ``seats`` in each group: floors, then one more to the largest
    fractions, ties by order.  Weights or seats of zero get none."""
    every = Window.partitionBy(*group)
    exact = F.when(F.sum(weight).over(every) > 0, F.col(weight) * seats / F.sum(weight).over(every)).otherwise(F.lit(0.0))
    made = df.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    rest = F.when(F.sum(weight).over(every) > 0, seats - F.sum("_floor").over(every)).otherwise(F.lit(0))
    made = made.withColumns({"_rest": rest, "_row": F.row_number().over(every.orderBy(F.desc(F.col("_exact") - F.col("_floor")), *order))})
    return made.withColumn(out, (F.col("_floor") + (F.col("_row") <= F.col("_rest")).cast("int")).cast("bigint")).drop("_exact", "_floor", "_rest", "_row")


def quota_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    bands, races = vocab.MODERATORS["age_band"], vocab.MODERATORS["race"]
    ages = spark.createDataFrame([(a, g, n, bands.index(a)) for (a, g), n in vocab.AGE_GENDER_COUNTS.items()], "age_band string, gender string, n long, age_ord int")
    return ages, spark.createDataFrame([(r, g, n, races.index(r)) for (r, g), n in vocab.RACE_GENDER_COUNTS.items()], "race string, gender string, n long, race_ord int")


def cell_targets(spark: SparkSession, n_total: int) -> DataFrame:
    """``gender, age_band, race, target`` summing to n_total.  Within a gender age and race are independent; the genders' weights are
    the means of what the two quota tables imply."""
    ages, races = quota_tables(spark)
    share = lambda t, c: t.withColumn("total", F.sum("n").over(Window.partitionBy("gender"))).withColumn(c, F.col("n") / F.col("total"))
    a, r = share(ages, "age_share"), share(races, "race_share")
    genders = a.select("gender", "total").distinct().unionByName(r.select("gender", "total").distinct()).groupBy("gender").agg((F.sum("total") / 2).alias("weight"))
    genders = apportion(genders, [], "weight", F.lit(n_total), [F.desc("gender")], "gender_seats")  # Male before Female
    cells = a.join(r, "gender").join(genders, "gender").withColumn("w", F.col("age_share") * F.col("race_share"))
    return apportion(cells, ["gender"], "w", F.col("gender_seats"), ["age_ord", "race_ord"], "target").select(*CELL, "target")


def valid_pool(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with known levels of the three quota variables, a row with counts of kept and dropped)."""
    known = F.lit(True)
    for c in CELL:
        known = known & F.coalesce(F.col(c).isin(vocab.MODERATORS[c]), F.lit(False))
    return pool.where(known), pool.agg(F.count_if(known).alias("kept"), F.count_if(~known).alias("dropped"))


#: Bins of the draw's hash in a cell.
DRAW_BINS = 4096


def _drawn(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with its hash, and the bin of the hash's order that it is in."""
    h = F.sha2(F.concat_ws("#", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("_hash", h).withColumn("_bin", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))


def _binned(hashed: DataFrame, cell: Sequence[str]) -> DataFrame:
    """``cell, _bin, _before``: how many rows of the cell are in the bins before.  At most DRAW_BINS rows a cell pass the window."""
    counts = hashed.groupBy(*cell, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*cell).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_before", F.coalesce(before, F.lit(0)))


def _placed(hashed: DataFrame, bins: DataFrame, cell: Sequence[str], key: str) -> DataFrame:
    """Rows of the given bins, with ``draw``: each bin is ranked by itself, so a cell with most of all rows is dealt over tasks."""
    named = bins.select(*[F.col(c).alias(f"_of_{c}") for c in cell], F.col("_bin").alias("_of_bin"), "_before", *[c for c in bins.columns if c == "_seats"])
    same = F.col("_bin") == F.col("_of_bin")
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = Window.partitionBy(*cell, "_bin").orderBy("_hash", key)
    return hashed.join(named, same).withColumn("draw", (F.col("_before") + F.row_number().over(inside)).cast("int")).drop("_hash", "_bin", "_before", "_of_bin", *[f"_of_{c}" for c in cell])


def draw_order(df: DataFrame, cell: Sequence[str], key: str, seed: int) -> DataFrame:
    """Adds ``draw``: places in a random order within each cell that depends on seed and key alone."""
    hashed = _drawn(df, key, seed)
    return _placed(hashed, _binned(hashed, cell), cell, key)


def draw_first(df: DataFrame, cell: Sequence[str], key: str, seed: int, quota: DataFrame | int) -> DataFrame:
    """The first rows of each cell in that order, with ``draw``: as many as quota (``cell, seats``, or one number) says.

    A histogram of the hash tells the bin in which a cell's last seat falls: rows behind it are left where they are read, and only
    bins up to it are ranked."""
    hashed = _drawn(df, key, seed)
    bins = _binned(hashed, cell)
    seated = bins.withColumn("_seats", F.lit(quota)) if isinstance(quota, int) else bins.join(quota.select(*cell, F.col("seats").alias("_seats")), list(cell))
    return _placed(hashed, seated.where(F.col("_before") < F.col("_seats")), cell, key).where(F.col("draw") <= F.col("_seats")).drop("_seats")


def redistribute(cells: list[dict], max_rounds: int = 10) -> int:
    """Adds ``extra`` to cells (dicts of target, available): the people that some cells lack are taken from cells that have more than
    their target, by largest remainders over the targets, as often as seats are left.  Returns what stays unmet.  For a few cells
    at hand, such as a quota sheet; redistribute_cells() does the same over a table."""
    spare = [max(0, c["available"] - c["target"]) for c in cells]
    taken = [0] * len(cells)
    need = sum(max(0, c["target"] - c["available"]) for c in cells)
    for _ in range(max_rounds):
        weights = [c["target"] if left > had else 0 for c, left, had in zip(cells, spare, taken, strict=True)]
        if need <= 0 or not sum(weights):
            break
        seats = min(need, sum(spare) - sum(taken))
        whole = [seats * w // sum(weights) for w in weights]
        # Integer remainders: no rounding decides between cells.
        by_rest = sorted((i for i, w in enumerate(weights) if w), key=lambda i: -(seats * weights[i] % sum(weights)))
        for i in by_rest[: seats - sum(whole)]:
            whole[i] += 1
        given = [min(n, left - had) for n, left, had in zip(whole, spare, taken, strict=True)]
        if not any(given):
            break
        taken = [had + n for had, n in zip(taken, given, strict=True)]
        need -= sum(given)
    for c, had in zip(cells, taken, strict=True):
        c["extra"] = had
    return max(0, need)


#: Cells that are ranked in one task; more are numbered by ranges.
CELLS_AT_ONCE = 100_000


def redistribute_cells(cells: DataFrame, keys: Sequence[str], max_rounds: int = 10) -> tuple[DataFrame, int]:
    """(cells with ``extra``, people who stay unmet) for ``keys, target, available``: the people that some cells lack are taken from
    cells that have more than their target, by largest remainders over the targets, as often as seats are left.

    A round is an aggregate over the cells, a rank of remainders and one pass; the driver sees a row of totals, so cells may be
    many.  Ties go in the order of keys."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    spare = F.greatest(F.lit(0), F.col("available") - F.col("target")).cast("bigint")
    state = written(cells.withColumns({"_spare": spare, "_had": F.lit(0).cast("bigint")}), "cells")
    first = state.agg(F.sum(F.greatest(F.lit(0), F.col("target") - F.col("available"))).alias("need"), F.count(F.lit(1)).alias("n")).first()
    need = int(first["need"] or 0)
    for _ in range(max_rounds):
        free = F.col("_spare") > F.col("_had")
        total = state.agg(F.sum(F.when(free, F.col("target")).otherwise(0)).alias("weight"), F.sum(F.col("_spare") - F.col("_had")).alias("left")).first()
        if need <= 0 or not total["weight"]:
            break
        seats, weight = min(need, int(total["left"])), int(total["weight"])
        share = F.when(free, wide("target") * F.lit(seats).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
        # Whole numbers and remainders: no rounding decides between cells.
        cut = state.withColumn("_share", share).withColumns({"_whole": F.expr(f"CAST(_share DIV {weight} AS BIGINT)"), "_rest": F.expr(f"CAST(_share % {weight} AS BIGINT)")})
        more = seats - int(cut.agg(F.sum("_whole")).first()[0])
        order = [F.col("target").cast("bigint") == 0, F.when(free, 0).otherwise(1), F.desc("_rest"), *[F.col(k) for k in keys]]
        if first["n"] <= CELLS_AT_ONCE:
            ranked = cut.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
        else:
            from .order import numbered

            ranked = numbered(cut, order, "_rank", 1)
        given = F.least(F.col("_whole") + ((F.col("_rank") <= more) & free & (F.col("target") > 0)).cast("int"), F.col("_spare") - F.col("_had"))
        made = written(ranked.withColumn("_given", given).select(*cells.columns, "_spare", (F.col("_had") + F.col("_given")).cast("bigint").alias("_had"), "_given"), "cells")
        got = int(made.agg(F.sum("_given")).first()[0] or 0)
        if not got:
            break
        state, need = made.drop("_given"), need - got
    return state.select(*cells.columns, F.col("_had").alias("extra")), max(0, need)


#: The columns of a sample.  Where a level came from is known to no step, so those columns are blank.
AGENT_COLUMNS = ["profile_id", "author", *vocab.MODERATORS, "gender_source", "age_source", "race_source", "education_source", "income_source", "party_source",
    "inference_confidence", "assigned_state", "sampling_weight", "quota_cell_id"]


def stratified_sample(pool: DataFrame, n: int = 1000, seed: int = 42, supplement: DataFrame | None = None, strict: bool = False, key: str = "author") -> tuple[DataFrame, DataFrame, dict]:
    """(agents, target and shortfall of each cell, diagnostics).  strict: no redistribution."""
    spark = pool.sparkSession
    if supplement is not None:
        pool = pool.unionByName(supplement, allowMissingColumns=True)
    people, counts = valid_pool(pool)
    targets = cell_targets(spark, n)
    there = people.groupBy(*CELL).agg(F.count(F.lit(1)).alias("available"))
    lacking = F.greatest(F.lit(0), F.col("target") - F.col("available")).cast("bigint")
    cells = targets.join(there, CELL, "left").select(*CELL, "target", F.coalesce("available", F.lit(0)).alias("available")).withColumn("shortfall", lacking)
    if strict:
        cells = written(cells.withColumn("extra", F.lit(0)), "cells")
        unmet = cells.agg(F.sum("shortfall")).first()[0]
    else:
        cells, unmet = redistribute_cells(cells, CELL)
    quota = cells.select(*CELL, (F.col("target") + F.col("extra")).alias("seats"))
    drawn = draw_first(people, CELL, key, seed, quota).drop("draw")
    label = Window.orderBy(F.sha2(F.concat_ws("#", F.lit(f"{seed}:label"), F.col(key)), 256), key)  # over the n people drawn
    agents = drawn.withColumns({
        "profile_id": F.format_string("agent_%04d", F.row_number().over(label)), "quota_cell_id": F.concat_ws("|", *CELL), "sampling_weight": F.lit(1.0),
        **{c: F.lit("") for c in AGENT_COLUMNS if c.endswith(("_source", "_confidence")) and c not in drawn.columns}, **({} if "assigned_state" in drawn.columns else {"assigned_state": F.lit("")}),
    })
    report = cells.select(*CELL, "target", F.col("shortfall").alias("shortfall_before_redistribution"))
    kept = counts.first()
    other = people.where(~F.col("gender").isin("Male", "Female")).count()
    return agents, report, {"dropped": kept.dropped, "excluded_other_gender": other, "unmet": unmet}


def achieved_margins(agents: DataFrame, targets: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``variable, category, achieved, target`` shares."""
    long = lambda df, n: df.unpivot([], list(variables), "variable", "category").groupBy("variable", "category").agg(F.count(F.lit(1)).alias(n))
    a = long(agents.select(*variables), "n").withColumn("achieved", F.col("n") / F.sum("n").over(Window.partitionBy("variable"))).drop("n")
    return a.join(targets.withColumnRenamed("share", "target"), ["variable", "category"], "full")
