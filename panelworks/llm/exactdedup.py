"""Exact dedup by content-defined chunk recipes.

Texts are equal when they are identical after each run of white space is made one space.  A normalised text
is cut into chunks where its own characters say so, with a least and a largest size; each chunk is named by
128 bits of hash, and the ordered names are the text's *recipe*.  Only recipes travel: some 16 bytes for a
kilobyte of text, and of a recipe only a 128-bit name of its own where texts are counted.

A name proves nothing by itself, so names are verified.  Of documents whose recipes share a name, the chunks are
deduplicated by content, on the map side first (thousands of copies in a task send one), and a name that stands
for two contents is found there; so is a recipe's name that stands for two lists.  Then all names are drawn anew
with another seed.  Once there is none, equal lists of names are equal texts, and unequal lists are unequal
ones.  Documents whose recipe is unlike all others never move: a bitmap of fixed size, built by an aggregate
and joined by broadcast, tells the scan which documents to cut up.

Groups with a large share of the rows are sent to the rows; others meet them by a shuffle of names (see
``common.join_groups``).  Only built-in functions are used.

Defined results: a null text counts as empty, so null, empty and no text are one group, apart from a text of
white space, which is one space; null ids come last, so one is kept only where a group has no other; of rows
that repeat an id one is kept, by a hash of the text as it was, then by any order; further columns are kept by
``keep_one`` and left out by ``duplicates``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, keep_first, materialize, row_keys

#: A border may lie between a word that ends in one of some letters and one that begins with one of some, or between
#: characters of a slice of the scripts that don't part words.
BORDER = r"(?<=[dnsrye.,]\x20)(?=[a-fA-F])|(?<=[\x{4E00}-\x{51FF}\x{3042}-\x{3050}])(?=[\x{6000}-\x{6FFF}\x{3060}-\x{307F}])"
LEAST, MOST = 1024, 16_384
#: Bits of the bitmap of repeated recipes: as rows of 64 bits, at most 2^18.
MAP_BITS = 24
#: Names are drawn anew at most so often; 128 bits make one more draw an event never seen.
DRAWS = 16


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """A text column as an array of chunks, which make the text when joined: a cut is at the first border after ``least``
    characters, or after ``most``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?(?:{BORDER})|.{{1,{most}}}"), F.lit(0))


def _name(value: Column, seed: int, bits: int) -> Column:
    """128 bits of hash (twice ``bits``, in tests) under a seed."""
    half = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + k), value), 64 - bits)
    return F.struct(half(0).alias("a"), half(1).alias("b"))


def _cut(docs: DataFrame, seed: int, bits: int, least: int, most: int, *more: Column) -> DataFrame:
    """``chunks, recipe, name`` and further columns, in a narrow stage."""
    cut = docs.select(*more, normalized(F.col("text")).alias("norm")).withColumn("chunks", chunks(F.col("norm"), least, most))
    named = cut.withColumn("recipe", F.transform("chunks", lambda c: _name(c, seed, bits)))
    return named.withColumn("name", _name(F.col("recipe"), seed, bits))


def recipes(docs: DataFrame, seed: int = 0, bits: int = 64, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per row of docs: ``doc_id, row, n, text_sha256, recipe, name``; row tells rows apart but for those alike in
    id and text, n those too.  Written into the shared folder."""
    made = _cut(docs, seed, bits, least, most, F.col("doc_id"), row_keys().alias("row"))
    return materialize(made.select("doc_id", "row", F.monotonically_increasing_id().alias("n"), F.sha2("norm", 256).alias("text_sha256"), "recipe", "name"), "exact-recipes")


def _bitmap(names: DataFrame) -> DataFrame:
    """``word, bits``: which of the 2^MAP_BITS slots the names have, 64 to a row."""
    slot = F.shiftrightunsigned("name.a", 64 - MAP_BITS)
    return names.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(name.a & 63 as int))")).alias("bits"))


def verified(docs: DataFrame, repeated: DataFrame, listed: DataFrame, seed: int, bits: int, least: int, most: int) -> bool:
    """Whether no name of a chunk or recipe stands for two contents, among documents whose recipe's name is in repeated."""
    lists = listed.join(repeated.select("name"), "name", "left_semi") if repeated.count() > 0 else None
    if lists is None:
        return True
    sent = F.broadcast(_bitmap(repeated))
    cut = _cut(docs, seed, bits, least, most).withColumn("word", F.shiftright(F.shiftrightunsigned("name.a", 64 - MAP_BITS), 6))
    some = cut.join(sent, "word").where(F.expr("getbit(bits, cast(name.a & 63 as int)) = 1"))
    content = some.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("c")).select(F.col("c.recipe").alias("name"), F.col("c.chunks").alias("content"))
    twice = lambda df: df.distinct().groupBy("name").count().where("count > 1")
    return twice(content).isEmpty() and twice(lists).isEmpty()


def groups(docs: DataFrame, bits: int = 64, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(recipes; of those that occur more than once ``name, first, size``), names verified."""
    for seed in range(DRAWS):
        listed = recipes(docs, seed, bits, least, most)
        first = F.min(F.struct("row", "n")).alias("first")
        repeated = materialize(listed.groupBy("name").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1"), "exact-groups")
        if verified(docs, repeated, listed.select("name", "recipe"), seed, bits, least, most):
            return listed, repeated
    raise RuntimeError(f"names of {2 * bits} bits stand for several chunks under {DRAWS} seeds")


def duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: ``doc_id, keep_id, group_size, kept, text_sha256``.  options: as of groups()."""
    listed, repeated = groups(docs, **options)
    small = listed.select("doc_id", "row", "n", "text_sha256", "name")
    joined = join_groups(small, repeated, ["name"], "size", small.count())
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("doc_id")).when(~F.col("first.row.none"), F.col("first.row.id").cast(docs.schema["doc_id"].dataType))
    kept = alone | (F.struct("row", "n") == F.col("first"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all columns: of equal texts the one of the smallest id."""
    listed, repeated = groups(docs, **options)
    small = listed.select("row", "name")
    joined = join_groups(small, repeated.select("name", F.col("first.row").alias("root"), "size"), ["name"], "size", small.count())
    return keep_first(docs, joined.select("row", F.coalesce("root", "row").alias("root")))
