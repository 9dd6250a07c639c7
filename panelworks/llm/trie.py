"""Prefix tries of conversations: what a serving cache would save where conversations begin alike.

Construction is level-synchronous.  At each depth the live conversations, those that still share their
prefix with another, are grouped by (parent node, next turn); a group is a node, named by its smallest member.
A conversation that is alone in its group leaves: the rest of it is a chain, emitted by one join at the end, however long
it is.  So there are as many levels as the deepest prefix that two conversations share; past ``levels`` of them,
subtrees of a bounded number of turns are built, level by level too, in one task each.  Then joins from the deepest
level to the root roll up children, leaves and savings.

A turn is its SHA-256 over role and text, made where it is read; texts never move.  Groups with a large share of the
conversations get their node by broadcast, others by a shuffle (``common.join_groups``), so that a first turn which a
third of all conversations share fills no task.  A conversation with a third of all turns is numbered by ranges of the
order, with an offset for each range in which it goes on.  Which conversations end at a node is
told by a SHA-256 over their ids in order, which can't be summed from parts: ranges of the sorted ids are joined to pieces in
parallel, and a task streams a node's pieces, holding one at a time.  Every level is a table in the shared folder.

Defined results: turns are in the order of ``turn``, null first, and at the same turn in the order of the SHA-256 of role and
text, so repeated rows are repeated turns; null role or text is empty; rows without a conversation id belong to no
conversation and take no part; further columns play none; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize

#: Depths that are always built by joins over all conversations.
LEVELS = 12
#: Turns of a subtree that one task may build beyond those.
LOCAL_TURNS = 20_000
#: Ids in a piece of a node's list of ends.
PIECE = 4096
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv, pos, key, chars`` and ``n``, how many turns the conversation has: turns numbered from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", key.alias("key"), F.char_length(text).cast("bigint").alias("chars"))
    # The salt parts rows that are alike; their order doesn't matter.
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("turn").asc_nulls_first(), F.col("key"), F.col("salt")]
    cut = materialize(salted.repartitionByRange(F.col("conv"), *order).withColumn("range", F.spark_partition_id()), "trie-ranges")
    counts = cut.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("here"))
    of_conv = Window.partitionBy("conv")  # a row for each range of a conversation
    before = F.sum("here").over(of_conv.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.select("conv", "range", F.coalesce(before, F.lit(0)).alias("offset"), F.sum("here").over(of_conv).alias("n")), "trie-counts")
    # A border of ranges lies in one conversation at most, so these are as few as ranges.
    offsets = F.broadcast(counts.where("offset > 0").select("conv", "range", "offset"))
    place = F.row_number().over(Window.partitionBy("range", "conv").orderBy(*order))
    made = cut.withColumn("place", place).join(offsets, ["conv", "range"], "left")
    sizes = counts.where("offset = 0").select("conv", "n")
    made = materialize(made.select("conv", (F.col("place") + F.coalesce("offset", F.lit(0))).cast("bigint").alias("pos"), "key", "chars"), "trie-numbered")
    return join_groups(made, sizes, ["conv"], "n", made.count(), "inner")


def rebuilt(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """(turns; ``conv, len``) of every conversation made anew: the first ``head`` turns of the conversation ``base``, columns
    over ``conv``, then its own turns after its first ``head``.  head must be small: that many turns are copied."""
    turns = materialize(turns, "trie-own")
    total = turns.count()
    convs = turns.where("pos = 1").select("conv", "n", base.alias("base"), head.cast("bigint").alias("head"))
    lengths = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    copied = F.least("head", F.coalesce("n_base", F.lit(0).cast("bigint")))
    convs = convs.join(lengths, "base", "left").select("conv", "base", "head", "n", copied.alias("copied"))
    convs = materialize(convs.withColumn("len", F.greatest(F.col("n") - F.col("head"), F.lit(0)) + F.col("copied")), "trie-convs")
    most = convs.agg(F.max("copied")).first()[0] or 0
    heads = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "key", "chars")
    first = convs.join(heads, "base").where("pos <= copied").select("conv", "pos", "key", "chars")
    own = join_groups(turns.drop("n"), convs.select("conv", "head", "copied", "n"), ["conv"], "n", total, "inner").where("pos > head")
    own = own.select("conv", (F.col("pos") - F.col("head") + F.col("copied")).alias("pos"), "key", "chars")
    # In the order of depths, so a level reads little more than its own turns.
    return materialize(first.unionByName(own).sortWithinPartitions("pos"), "trie-turns"), convs.select("conv", "len")


def of_conversations(conversations: DataFrame, **options) -> DataFrame:
    """The trie of conversations as they are, see prefix_trie()."""
    turns = materialize(turn_rows(conversations), "trie-own")
    return prefix_trie(turns.drop("n"), turns.where("pos = 1").select("conv", F.col("n").alias("len")), **options)


def _finish(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes below one node, of all turns of its members beyond its depth."""
    depth, top = int(rows["depth"].iloc[0]), int(rows["node"].iloc[0])
    turns: dict[int, list] = defaultdict(list)
    for conv, key, chars in rows.sort_values(["conv", "pos"])[["conv", "key", "chars"]].itertuples(index=False):
        turns[conv].append((bytes(key), chars))
    levels, live = [], {top: sorted(turns)}
    while live:
        level, following = [], {}
        for parent, members in live.items():
            split: dict[bytes, list[int]] = defaultdict(list)
            for c in members:
                split[turns[c][len(levels)][0]].append(c)
            for group in split.values():
                on = [c for c in group if len(turns[c]) > len(levels) + 1]
                ends = ",".join(str(c) for c in group if len(turns[c]) == len(levels) + 1)
                level.append((group[0], parent, len(group), turns[group[0]][len(levels)][1], hashlib.sha256(ends.encode()).hexdigest()))
                if on:
                    following[group[0]] = on
        levels.append(level)
        live = following
    made, below = [], {}
    for k in range(len(levels) - 1, -1, -1):
        above: dict[int, list[int]] = {}
        for conv, parent, n, chars, ends in levels[k]:
            children, leaves, saved = below.get(conv, (0, 1, 0))
            saved += (n - 1) * chars
            made.append((depth + 1 + k, conv, parent, n, children, leaves, saved, ends))
            kin = above.setdefault(parent, [0, 0, 0])
            kin[0], kin[1], kin[2] = kin[0] + 1, kin[1] + leaves, kin[2] + saved
        below = above
    return pd.DataFrame(made, columns=["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``depth, node, conv`` -> runs of ids joined by commas."""
    node, ids = None, []

    def piece():
        return pa.RecordBatch.from_pylist([{"depth": node[0], "node": node[1], "first": ids[0], "ids": ",".join(map(str, ids))}])

    for batch in batches:
        for depth, of, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv")), strict=True):
            if ids and (node != (depth, of) or len(ids) >= PIECE):
                yield piece()
                ids = []
            node = (depth, of)
            ids.append(conv)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> the SHA-256 of each node's list."""
    node, state = None, None

    def digest():
        return pa.RecordBatch.from_pylist([{"depth": node[0], "conv_id": node[1], "ends_sha256": state.hexdigest()}])

    for batch in batches:
        for depth, of, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
            if node != (depth, of):
                if node is not None:
                    yield digest()
                node, state = (depth, of), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield digest()


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, node, conv`` -> ``depth, conv_id, ends_sha256`` for nodes at which a conversation ends."""
    order = ["depth", "node", "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, node long, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, levels: int = LEVELS, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    turns: ``conv, pos, key, chars``, pos from 1 without gaps.  lengths: ``conv, len``, for conversations without turns too."""
    spark = turns.sparkSession
    root = lengths.agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n")).first()
    empty = spark.createDataFrame([], NODE + ", ends_sha256 string")
    if not root["n"]:
        return empty
    live, alive, depth = lengths.withColumn("node", F.lit(root["node"])), root["n"], 0
    made = [spark.createDataFrame([(root["node"], None, root["n"], 0, 0)], "child long, node long, n long, chars long, len long")]
    ends, local = [], []

    def ended(at: DataFrame) -> DataFrame:
        return at.where(F.col("len") == depth).select(F.lit(depth).cast("bigint").alias("depth"), "node", "conv")

    while True:
        ends.append(ended(live))
        if depth >= levels:
            live = _apart(live, turns, depth, alive, local_turns, local)
        depth += 1
        step = live.where(F.col("len") >= depth).join(turns.where(F.col("pos") == depth).drop("pos"), "conv")
        nodes = materialize(step.groupBy("node", "key").agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.max("len").alias("len")), "trie-nodes")
        seen = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("alive")).first()
        if seen["nodes"]:
            made.append(nodes.drop("key"))
        if not seen["alive"]:
            break
        shared = nodes.where("n > 1").select("node", "key", "child", "n")
        live = join_groups(step, shared, ["node", "key"], "n", alive, "inner").select("conv", "len", F.col("child").alias("node"))
        live, alive = materialize(live, "trie-live"), seen["alive"]

    built = empty
    for part in local:
        built = built.unionByName(part)
    rolled = _roll_up(made, built)
    digests = ends[0]
    for e in ends[1:]:
        digests = digests.unionByName(e)
    found = rolled.join(ends_digests(digests), ["depth", "conv_id"], "left")
    found = found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return found.unionByName(_chains(made, turns)).unionByName(built).select("conv_id", "depth", *[c for c in empty.columns if c not in ("conv_id", "depth")])


def _apart(live: DataFrame, turns: DataFrame, depth: int, alive: int, most: int, local: list[DataFrame]) -> DataFrame:
    """The live conversations below nodes with more than ``most`` turns to come; the others' subtrees are built and added to local."""
    sizes = live.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("len") - depth).alias("turns"))
    told = materialize(join_groups(live, sizes, ["node"], "n", alive, "inner"), "trie-told")
    small = told.where((F.col("turns") <= most) & (F.col("len") > depth)).select("conv", "node")
    rows = turns.where(F.col("pos") > depth).join(small, "conv").withColumn("depth", F.lit(depth))
    local.append(materialize(rows.groupBy("node").applyInPandas(_finish, NODE + ", ends_sha256 string"), "trie-local"))
    return told.where(F.col("turns") > most).select("conv", "len", "node")


def _roll_up(made: list[DataFrame], built: DataFrame) -> DataFrame:
    """Nodes that several conversations share (and the root), with what is below them, from the deepest level up."""
    done, below = None, None
    for depth in range(len(made) - 1, -1, -1):
        nodes = made[depth].where("n > 1") if depth else made[0]
        deeper = built.where(F.col("depth") == depth + 1).select("parent_conv_id", "n_leaves", "saved_tokens")
        if below is not None:
            deeper = deeper.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        if depth + 1 < len(made):
            alone = made[depth + 1].where("n = 1")
            deeper = deeper.unionByName(alone.select(F.col("node").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens")))
        sums = deeper.groupBy(F.col("parent_conv_id").alias("child")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nothing = F.lit(0).cast("bigint")
        below = materialize(
            nodes.join(sums, "child", "left").select(
                F.lit(depth).cast("bigint").alias("depth"), F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("kids", nothing).alias("n_children"),
                F.coalesce("leaves", F.lit(1).cast("bigint")).alias("n_leaves"), ((F.col("n") - 1) * F.col("chars") + F.coalesce("saved", nothing)).alias("saved_tokens")),
            "trie-rolled")
        done = below if done is None else done.unionByName(below)
    return done


def _chains(made: list[DataFrame], turns: DataFrame) -> DataFrame:
    """Nodes of one conversation alone, from where it leaves the others to its end."""
    alone = None
    for depth, nodes in enumerate(made[1:], 1):
        part = nodes.where("n = 1").select(F.col("child").alias("conv"), F.col("node").alias("parent"), "len", F.lit(depth).cast("bigint").alias("start"))
        alone = part if alone is None else alone.unionByName(part)
    if alone is None:
        return turns.sparkSession.createDataFrame([], NODE + ", ends_sha256 string")
    rows = join_groups(turns.select("conv", "pos"), alone, ["conv"], "len", turns.count(), "inner").where("pos >= start")
    one, last = F.lit(1).cast("bigint"), F.col("pos") == F.col("len")
    return rows.select(
        F.col("pos").alias("depth"), F.col("conv").alias("conv_id"), F.when(F.col("pos") == F.col("start"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"))
