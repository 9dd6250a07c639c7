"""Mixing sources to target weights.

Capped water-filling: sources whose share exceeds ``max_epochs`` times their size are clamped there and
the excess goes to the others in proportion to their weights, until no source is above its clamp.  Over
sources sorted by clamp / weight that fixed point is one cut: a prefix is clamped, the rest shares what
remains.  A source's target is then taken as whole passes over all its documents and one fractional pass
over the first of them in a seeded hash order.  The cut in that order is found by a histogram of the
hash (a row per source and bin) and a running sum inside the one bin that holds it, so no source,
however large, is sorted in one task.  The document at the cut is taken in part, in words, so each
source meets its target to within rounding.

Only built-in functions are used.  Text is read once: sizes are written to the shared folder.
The source table (a row per source) is ordered in ranges; what passes through one task is a row per range.

Defined results: null text has size 0; null source is a source of its own, ordered last; a source
without words has target 0; rows that repeat an id share its place in the order, and at the cut share what
is taken there; sources of equal clamp / weight are clamped or not alike, null among them; a null id is placed last among equal hashes; an empty table gives an empty table; further
columns are kept by ``repeat_documents`` and left out by ``mix_sources``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, free_prefix, materialize, word_count

#: Sources up to this many are joined by broadcast (a row of some 60 bytes each); more are shuffled.
BROADCAST_SOURCES = 100_000
BITS = 48
#: Ranges into which the source table is cut where it is ordered.
RANGES = 32


def _running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each of sums, its total over all rows before in a total order.  Ranges of the order are summed
    apart, so no task holds all rows; a row per range is broadcast."""
    cut = materialize(df.repartitionByRange(RANGES, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    total = cut.groupBy("range").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    # As many rows as there are ranges.
    offsets = total.select("range", *[F.coalesce(F.sum(k).over(before.orderBy("range")), F.lit(0)).alias(f"{k}_offset") for k in sums])
    within = before.partitionBy("range").orderBy(*order)
    joined = cut.join(F.broadcast(offsets), "range")
    made = {k: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{k}_offset") for k, c in sums.items()}
    return joined.withColumns(made).drop("range", *[f"{k}_offset" for k in sums])


def water_fill(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """``source, source_size`` -> with ``weight, target``.  One row per source."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = _running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("bigint")})
    t = t.withColumn("weight", F.get(w, (F.col("place") % len(weights)).cast("int")))
    t = t.withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("clamp") / F.col("weight"))
    # Ties are in the order of places, which are never null: the level below is taken in the very same order.
    t = _running(t, [F.col("ratio"), F.col("place")], {"clamped": F.col("clamp"), "passed": F.col("weight")})
    all_ = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if all_["size"] is None:
        return t.select("source", "source_size", "weight", F.col("clamp").alias("target"))
    # The level at which this source and all later ones would stand if the earlier ones are clamped.
    t = t.withColumn("level", (F.lit(float(all_["size"] * share)) - F.col("clamped")) / (F.lit(all_["weight"]) - F.col("passed")))
    fits = F.col("level") * F.col("weight") <= F.col("clamp")
    stands = t.agg(F.min(F.when(fits, F.struct("ratio", "place", "level"))).alias("least")).select("least.level").first()[0]
    target = F.col("clamp") if stands is None else F.least(F.col("clamp"), F.lit(stands) * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _key(seed: int):
    """The place of a document in the seeded order of its source."""
    return F.struct(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - BITS).alias("u"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc"))


def plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, bins: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source, size, key`` per row; per source ``source_size, target, passes, cut, cut_share``).

    Each document is taken ``passes`` times, once more if its key is before ``cut``, and by the share
    ``cut_share`` of its words if its key is at the cut."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key")), "mix-sizes")
    sized = sized.withColumn("bin", F.shiftright("key.u", BITS - (bins.bit_length() - 1)))
    histogram = materialize(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    targets = water_fill(histogram.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, max_epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    targets = targets.withColumn("passes", passes)
    targets = targets.withColumn("rest", F.rint(F.col("target")).cast("bigint") - F.col("passes") * F.col("source_size"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    before = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``bins`` rows per source pass here.
    below = histogram.withColumn("below", F.coalesce(F.sum("bin_size").over(before.orderBy("bin")), F.lit(0)))
    cut_bin = below.alias("h").join(targets.alias("t"), same("h", "t")).where("h.below < t.rest AND t.rest <= h.below + h.bin_size")
    cut_bin = cut_bin.select("h.source", "h.bin", (F.col("t.rest") - F.col("h.below")).alias("wanted"))
    # And here the documents of one bin per source.
    inside = sized.alias("d").join(cut_bin.alias("c"), same("d", "c") & (F.col("d.bin") == F.col("c.bin")))
    inside = inside.groupBy("d.source", "d.key").agg(F.sum("d.size").alias("size"), F.max("c.wanted").alias("wanted"))
    inside = inside.withColumn("below", F.coalesce(F.sum("size").over(before.orderBy("key")), F.lit(0)))
    cut = inside.where("below < wanted AND wanted <= below + size")
    cut = cut.select("source", F.col("key").alias("cut"), ((F.col("wanted") - F.col("below")) / F.col("size")).alias("cut_share"))
    info = targets.alias("t").join(cut.alias("c"), same("t", "c"), "left")
    info = info.select("t.source", "t.source_size", "t.target", "t.passes", "c.cut", "c.cut_share")
    return sized.drop("bin"), materialize(info, "mix-targets")


def _joined(rows: DataFrame, info: DataFrame, own: str = "plan_") -> DataFrame:
    """rows with the columns of their source's plan, their names after ``own``; rows stay where they are unless there are very
    many sources."""
    info = info.select(*[F.col(c).alias(own + c) for c in ("source", "source_size", "target", "passes", "cut", "cut_share")])
    if info.count() <= BROADCAST_SOURCES:
        info = F.broadcast(info)
    return rows.join(info, F.col("source").eqNullSafe(F.col(f"{own}source")), "left")


def mix_sources(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """One row per row of docs: ``doc_id, source, size, source_size, target, passes, part, taken``.

    ``passes`` whole repetitions and ``part`` words of a further one; ``taken`` counts both."""
    sized, info = plan(docs, seed=seed, **options)
    at_cut = F.rint(F.col("plan_cut_share") * F.col("size"))
    part = F.when(F.col("key") < F.col("plan_cut"), F.col("size")).when(F.col("key") == F.col("plan_cut"), at_cut).otherwise(F.lit(0)).cast("bigint")
    made = _joined(sized, info).withColumn("part", part)
    names = {"source_size": F.col("plan_source_size"), "target": F.col("plan_target"), "passes": F.col("plan_passes")}
    taken = (F.col("plan_passes") * F.col("size") + F.col("part")).cast("bigint").alias("taken")
    return made.select("doc_id", "source", "size", *[c.alias(k) for k, c in names.items()], "part", taken)


def repeat_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, as often as they are taken; the document at a cut is
    taken whole or not, whichever is nearer.  Texts are not shuffled."""
    _, info = plan(docs, seed=seed, **options)
    own = free_prefix(docs.columns)
    key, cut = F.col(f"{own}key"), F.col(f"{own}cut")
    joined = _joined(docs.withColumn(f"{own}key", _key(seed)), info, own)
    more = (key < cut) | ((key == cut) & (F.col(f"{own}cut_share") >= 0.5))
    times = (F.col(f"{own}passes") + F.coalesce(more, F.lit(False)).cast("int")).cast("int")
    repeated = joined.withColumn(f"{own}times", times).where(F.col(f"{own}times") > 0)
    return repeated.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}times")))).select(*docs.columns)
