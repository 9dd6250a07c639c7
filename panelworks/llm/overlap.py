"""Exact overlap of word shingles: which of some candidate texts are near copies.

A text, with A-Z lower-cased, is the set of its shingles of ``shingle`` words (a shorter text is one shingle).  Two texts are near
copies where the Jaccard similarity of their sets is at least ``similarity``.

Candidates come in groups (``node, size, group``): near copies that are in different groups are not found, so whoever
makes the groups answers for that.  Only texts of groups are sent (they take less room than their sets), one for each set, small
groups several to a task; a large group is cut into parts, and each two parts meet in a task.  A task verifies by exact
intersection what is not yet connected in it, along prefixes: with the shingles of a task's sets in one order, rare ones
first, two sets of that similarity share one of their first n - ceil(similarity * n) + 1.  It returns a spanning forest, never
all pairs.

Defined results: null text has no words; texts without words are alike; equal sets are one node, so copies cost
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowFilter, WordHashes, hashed, utf8
from .decontam import runs

_U = np.uint64
#: Shingles and sets of one part of a candidate group.
PART, PART_SETS = 1 << 20, 1 << 12
_NEAR = 1e-9


def shingles(text: bytes, size: int, memo: WordHashes) -> np.ndarray:
    """The distinct shingles of a UTF-8 text, as sorted hashes."""
    codes = hashed(text.lower().split(), memo)
    return np.unique(runs(codes, min(size, len(codes)))) if len(codes) else np.empty(0, _U)


def node_of(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes()) - (1 << 63)


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - _NEAR) + 1 if n else 0


def texts_of(keyed: DataFrame, groups: DataFrame, shingle: int) -> DataFrame:
    """``node, text``: texts of the sets in groups, and perhaps of some more."""
    wanted = RowFilter(groups, F.col("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHashes(), set()
        for batch in batches:
            nodes = np.array([node_of(shingles(t.as_py() or b"", shingle, memo)) for t in utf8(batch.column("text"))], np.int64)
            found = [i for i in np.flatnonzero(wanted(nodes)).tolist() if nodes[i] not in seen]
            if len(seen) < 100_000:
                seen.update(nodes[found].tolist())
            yield pa.record_batch([pa.array(nodes[found]), batch.column("text").take(pa.array(found, pa.int64()))], names=["node", "text"])

    return keyed.select("text").mapInArrow(run, "node bigint, text string")


def verified(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of all pairs of sorted sets with at least the similarity."""
    label = np.arange(len(sets))
    members = {i: [i] for i in range(len(sets))}
    sizes = np.array([len(s) for s in sets], np.int64)
    index: dict[int, list[int]] = {}
    made = []
    _, at, counts = np.unique(np.concatenate([np.empty(0, _U), *sets]), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    for i in np.argsort(sizes, kind="stable").tolist():
        own = at[ends[i] - sizes[i] : ends[i]]
        first = own[np.argsort(counts[own], kind="stable")[: prefix_size(len(own), similarity)]].tolist()
        near = [index[t] for t in first if t in index]
        if near:
            c = np.unique(np.concatenate([np.array(x, np.int64) for x in near]))
            c = c[sizes[c] >= similarity * sizes[i] - _NEAR]
            c = c[label[c] != label[i]]
            while len(c):
                j = int(c[0])
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                c = c[1:]
                if both >= similarity * (sizes[i] + sizes[j] - both) - _NEAR:
                    made.append((i, j))
                    keep, gone = sorted((int(label[i]), int(label[j])), key=lambda x: -len(members[x]))
                    label[members[gone]] = keep
                    members[keep] += members.pop(gone)
                    c = c[label[c] != label[i]]
        for t in first:
            if counts[t] > 1:
                index.setdefault(t, []).append(i)
    return made


def links(texts: DataFrame, groups: DataFrame, shingle: int, similarity: float, part: int = PART, part_sets: int = PART_SETS) -> DataFrame:
    """``a, b``: nodes with at least the similarity, which connect all such."""
    parts = F.greatest(F.ceil(F.sum("size") / part), F.ceil(F.count(F.lit(1)) / part_sets), F.lit(1))
    sums = groups.groupBy("group").agg(parts.cast("bigint").alias("parts"), F.sum("size").alias("total"))
    whole = sums.agg(F.sum("total")).first()[0] or 0
    lots = max(1, -(-4 * whole // part))
    placed = groups.join(sums, "group").select(
        "node", F.when(F.col("parts") > 1, F.col("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(lots))).alias("lot"), "parts",
        F.pmod(F.xxhash64("node"), F.col("parts")).alias("own"))
    placed = placed.select("node", "lot", "parts", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    placed = placed.select("node", "lot", (F.col("parts") > 1).alias("cut"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        memo = WordHashes()
        sets = [shingles(t.as_py() or b"", shingle, memo) for t in utf8(table.column("text"))]
        made = np.array(verified(sets, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[made[:, 0]], "b": nodes[made[:, 1]]})

    return texts.dropDuplicates(["node"]).join(placed, "node").groupBy("cut", "lot", "i", "j").applyInArrow(run, "a bigint, b bigint")
