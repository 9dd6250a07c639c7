"""SimHash near-deduplication with tiled exact comparison.

Two operators share the method.  ``near_duplicates`` links fingerprints of 64 bits within a few bits of each other.  ``keep_one``
keeps one of each group of near copies by Jaccard similarity of word shingles; see there.

Fingerprints.  A text, with A-Z lower-cased, is cut into words and shingles of ``shingle`` words; a bit of
its fingerprint is set where it is set in over half of the shingles' XXH64.  A shorter text is one
shingle; a text without words has fingerprint zero.

Comparison.  Distinct fingerprints are compared exactly, in tiles, by exclusive-or and bit counts.
Whole tiles are skipped by population counts: two words that differ in at most ``radius`` bits have population
counts, taken over each quarter of the word, that differ by at most the radius in sum.  Coarse tiles (four
counts to a block) are the unit of work: a fingerprint is at home in its own and visits those lower
neighbours that it could reach.  Inside, finer tiles of equal counts are compared with what lies within
the radius.  A tile with many fingerprints is dealt over several tasks, both its own and its visitors, so no task grows
with the input.  A task returns a spanning forest of the links that it found, never all pairs: thousands of
near copies cost thousands of rows.

Sets of shingles (``keep_one``).  At a Jaccard similarity of 0.8 fingerprints of 64 bits differ by ten bits, more or less, and a
radius that misses none hardly tells copies from strangers.  So fingerprints of sets have 256 bits, of which the first 128 are
compared by exclusive-or and bit counts, and the others where those are near.  Tiles are sets of like size: similar sets
differ in size by the similarity at most, so a tile meets itself and the next, and inside, sizes and
population counts rule out blocks.  What is near groups the texts; ``overlap`` then verifies by exact intersection.  Measured recall of
the grouping is in the README; what passes it is exact.

Defined results: null text has no words; equal texts link through their common fingerprint; null ids are
placed like any other but are never a component's smallest id unless all its ids are null; repeated rows
give repeated rows; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import overlap
from .common import ROW, WordHashes, keep_first, materialize, mix, row_keys, slices, utf8
from .graph import components

_U = np.uint64
SEED = 42
#: Fingerprints at home in one task, visitors of one task, and pairs compared at once.
HOME, VISIT, BLOCK = 1 << 14, 1 << 16, 1 << 20
_QUARTERS = np.array([0, 16, 32, 48], _U)
#: Hashes from which on bits are counted by way of byte values, and the bits of a byte.
_FEW = 48
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)
#: Words of a set's fingerprint, the radius over the first two, and over all.
LANES, NEAR, RADIUS = 4, 36, 64
#: Steps to neighbouring coarse tiles: a radius of 3 crosses at most three borders.
_STEPS = [s for s in itertools.product((-1, 0, 1), repeat=4) if 0 < sum(map(abs, s)) <= 3]


def fingerprint_many(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Fingerprints of UTF-8 texts."""
    hashes = []
    for t in texts:
        ws = t.lower().split()
        parts = list(map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False))) if len(ws) >= shingle else [b" ".join(ws)] if ws else []
        hashes.append(np.fromiter(map(xxh64_intdigest, parts, itertools.repeat(SEED)), _U, len(parts)))
    return majority(hashes)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Of each array of hashes a word whose bits are set where they are set in over half of them."""
    if not hashes:
        return np.empty(0, _U)
    sizes = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), 64), np.int64)
    for a, b in slices(sizes.tolist(), 1 << 16):
        if b - a == 1:  # perhaps a very long one
            for i in range(0, sizes[a], 1 << 16):
                counts[a] += _bit_counts(hashes[a][i : i + (1 << 16)], np.array([min(sizes[a] - i, 1 << 16)]))[0]
            continue
        order = a + np.argsort(sizes[a:b], kind="stable")
        order = order[sizes[order] > 0]
        few = np.searchsorted(sizes[order], _FEW)
        for rows in (order[:few], order[few:]):
            if len(rows):
                counts[rows] = _bit_counts(np.concatenate([hashes[i] for i in rows]), sizes[rows])
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(_U)[:, 0]


def _bit_counts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each bit is set, in each of the pieces of h (none empty)."""
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < _FEW * len(sizes):
        return np.add.reduceat(np.unpackbits(octets, axis=1, bitorder="little"), np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
    # Counts of byte values, then of their bits.
    at = np.repeat(np.arange(len(sizes), dtype=np.int64) * 2048, sizes)[:, None] + np.arange(0, 2048, 256)
    values = np.bincount((octets + at).ravel(), minlength=2048 * len(sizes)).reshape(-1, 256)
    return (values.astype(np.float32) @ _BITS_OF).astype(np.int64).reshape(-1, 64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, print`` (as a signed bigint) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = utf8(batch.column("text"))
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in column]
            for a, b in slices(sizes, 1 << 20):
                prints = fingerprint_many([t.as_py() or b"" for t in column[a:b]], shingle)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print bigint")


def quarter_counts(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] >> _QUARTERS & _U(0xFFFF)).astype(np.int16)


class Deal:
    """Which tasks a fingerprint goes to, given how many are at home in each coarse tile (at most 625 of them)."""

    def __init__(self, sizes: dict[int, int], radius: int, home: int, visit: int):
        self.radius, self.sizes = radius, sizes
        self.home_parts = np.ones(625, np.int64)
        self.visit_parts = np.ones(625, np.int64)
        for c, n in sizes.items():
            near = n + sum(sizes.get(d, 0) for d in self._above(c))
            self.home_parts[c] = -(-n // home)
            self.visit_parts[c] = -(-near // visit)

    @staticmethod
    def _above(c: int) -> list[int]:
        at = [c // 125, c // 25 % 5, c // 5 % 5, c % 5]
        out = []
        for step in _STEPS:
            x = [a + s for a, s in zip(at, step, strict=True)]
            if min(x) >= 0 and max(x) <= 4:
                d = ((x[0] * 5 + x[1]) * 5 + x[2]) * 5 + x[3]
                if d > c:
                    out.append(d)
        return out

    def place(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(task, fingerprint, at home) triples."""
        counts = quarter_counts(prints).astype(np.int64)
        block = counts // 4
        cell = ((block[:, 0] * 5 + block[:, 1]) * 5 + block[:, 2]) * 5 + block[:, 3]
        h = mix(prints)
        part = ((h & _U(0xFFFFFFFF)) % self.home_parts[cell].astype(_U)).astype(np.int64)
        lot = (h >> _U(32)).astype(np.int64)
        out = []

        def give(rows, cells, home_part, visit_part, home):
            out.append(((cells << 40) + (home_part << 20) + visit_part, prints[rows], np.full(len(rows), home)))

        everyone = np.arange(len(prints))
        for j in range(int(self.visit_parts[cell].max(initial=0))):  # at home, with each part of the visitors
            rows = everyone[self.visit_parts[cell] > j]
            give(rows, cell[rows], part[rows], np.full(len(rows), j), True)
        for i in range(int(self.home_parts[cell].max(initial=0))):  # to the lower parts of its own tile
            rows = everyone[part > i]
            give(rows, cell[rows], np.full(len(rows), i), lot[rows] % self.visit_parts[cell[rows]], False)
        down, up = counts % 4 + 1, 4 - counts % 4  # bits to the tile below and above, per quarter
        for step in _STEPS:
            to = block + np.array(step)
            cost = sum(np.where(s < 0, down[:, q], up[:, q]) if s else 0 for q, s in enumerate(step))
            other = ((to[:, 0] * 5 + to[:, 1]) * 5 + to[:, 2]) * 5 + to[:, 3]
            ok = (cost <= self.radius) & (to.min(1, initial=4) >= 0) & (to.max(1, initial=0) <= 4) & (other < cell)
            rows = everyone[ok]
            for i in range(int(self.home_parts[other[rows]].max(initial=0))):
                sub = rows[self.home_parts[other[rows]] > i]
                give(sub, other[sub], np.full(len(sub), i), lot[sub] % self.visit_parts[other[sub]], False)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Forest:
    """Spanning forest of links that come in batches."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.made: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins all pairs, keeping only those that join two trees."""
        while True:
            p, q = self.label[a], self.label[b]
            apart = p != q
            if not apart.any():
                return
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            # One pair for each tree on the right, less those that would close a circle.
            _, first = np.unique(q, return_index=True)
            to: dict[int, int] = {}

            def root(x: int, to=to) -> int:
                way = []
                while x in to:
                    way.append(x)
                    x = to[x]
                for y in way:
                    to[y] = x
                return x

            for i in first.tolist():
                x, y = root(int(p[i])), int(q[i])
                if x != y:
                    to[y] = x
                    self.made.append((int(a[i]), int(b[i])))
            new = np.arange(len(self.label))
            for y in list(to):
                new[y] = root(y)
            self.label = new[self.label]


def compare(home: np.ndarray, visitors: np.ndarray, radius: int, among_home: bool) -> list[tuple[int, int]]:
    """A spanning forest, as positions in home then visitors, of all links of home with visitors (and with home)."""
    other = np.concatenate((home, visitors)) if among_home else visitors
    shift = 0 if among_home else len(home)
    forest = _Forest(len(home) + len(visitors))
    home_counts, other_counts = quarter_counts(home), quarter_counts(other)
    code = ((home_counts[:, 0].astype(np.int64) * 17 + home_counts[:, 1]) * 17 + home_counts[:, 2]) * 17 + home_counts[:, 3]
    order = np.argsort(code, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(order))
    for a, b in itertools.pairwise(edges.tolist()):
        rows = order[a:b]
        near = np.flatnonzero(np.abs(other_counts - home_counts[rows[0]]).sum(1) <= radius)
        for i in range(0, len(rows), 1024):
            r = rows[i : i + 1024]
            width = max(1, BLOCK // len(r))
            for j in range(0, len(near), width):
                c = near[j : j + width]
                x, y = np.nonzero(np.bitwise_count(home[r][:, None] ^ other[c][None, :]) <= radius)
                if len(x):
                    x, y = r[x], c[y] + shift
                    keep = x != y
                    forest.link(x[keep], y[keep])
    return forest.made


def links(prints: DataFrame, radius: int = 3, home: int = HOME, visit: int = VISIT) -> DataFrame:
    """``a, b``: links of distinct fingerprints (column ``print``) that connect all that differ in at most radius bits."""
    if radius > 3:
        raise ValueError("coarse tiles are four counts wide, for a radius of 3 at most")
    q = [F.floor(F.bit_count(F.shiftright("print", s).bitwiseAND(F.lit(0xFFFF))) / 4) for s in (0, 16, 32, 48)]
    cell = (((q[0] * 5 + q[1]) * 5 + q[2]) * 5 + q[3]).cast("int")
    sizes = {r.cell: r.n for r in prints.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    deal = Deal(sizes, radius, home, visit)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, value, at_home = deal.place(batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64).view(_U))
            for i in range(0, len(task), 100_000):
                s = slice(i, i + 100_000)
                yield pa.record_batch([pa.array(task[s]), pa.array(value[s].view(np.int64)), pa.array(at_home[s])], names=["task", "print", "home"])

    def tile(table: pa.Table) -> pa.Table:
        value = table.column("print").to_numpy().astype(np.int64).view(_U)
        at_home = table.column("home").to_numpy().astype(bool)
        task = table.column("task")[0].as_py()
        own, rest = value[at_home], value[~at_home]
        both = np.concatenate((own, rest)).view(np.int64)
        made = np.array(compare(own, rest, radius, task & 0xFFFFF == 0), np.int64).reshape(-1, 2)
        return pa.table({"a": both[made[:, 0]], "b": both[made[:, 1]]})

    return prints.select("print").mapInArrow(place, "task bigint, print bigint, home boolean").groupBy("task").applyInArrow(tile, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of docs."""
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    distinct = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.select("print", "root").join(least, "root").select("print", "component_id")
    named = prints.join(of_print, "print", "left")
    return named.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- Sets of shingles --------------------------------------------------------------------------------------------------

def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of sets of hashes, sets x LANES."""
    return np.stack([majority(sets), *(majority([mix(h ^ _U(0x9E3779B97F4A7C15 * i % (1 << 64))) for h in sets]) for i in range(1, LANES))], axis=1)


_PRINTS = ", ".join(f"p{i} bigint" for i in range(LANES))


def printed(keyed: DataFrame, shingle: int) -> DataFrame:
    """``row, node, size, p0..``: of each of keyed (``row, text``) its set's name, its number of shingles, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            column = utf8(batch.column("text"))
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in column]
            for a, b in slices(sizes, 1 << 20):
                sets = [overlap.shingles(t.as_py() or b"", shingle, memo) for t in column[a:b]]
                prints = set_prints(sets).view(np.int64)
                yield pa.record_batch(
                    [batch.column("row").slice(a, b - a), pa.array([overlap.node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                     *(pa.array(prints[:, i]) for i in range(LANES))],
                    names=["row", "node", "size", *(f"p{i}" for i in range(LANES))])

    return keyed.mapInArrow(run, f"row {ROW}, node bigint, size int, {_PRINTS}")


def level_of(size: np.ndarray, similarity: float) -> np.ndarray:
    """Levels of like size: sets of at least the similarity are in the same or in neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / -np.log(similarity)).astype(np.int64)


def deal_levels(level: np.ndarray, node: np.ndarray, held: dict[int, int], home: int, visit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(task, position, at home) triples.  A set is at home in its level, and visits the parts of it below its own and
    all of the next level.  held: how many sets each level has."""
    top = max(held, default=0) + 2
    homes, visits = np.ones(top + 1, np.int64), np.ones(top + 1, np.int64)
    for k, n in held.items():
        homes[k], visits[k] = -(-n // home), -(-(n + held.get(k - 1, 0)) // visit)
    h = mix(node.view(_U))
    part, lot = ((h & _U(0xFFFFFFFF)) % homes[level].astype(_U)).astype(np.int64), (h >> _U(32)).astype(np.int64)
    some, everyone = np.array([k + 1 in held for k in range(top + 1)]), np.arange(len(level))
    out = []

    def give(rows, levels, home_part, visit_part, at_home):
        out.append(((levels << 40) + (home_part << 20) + visit_part, rows, np.full(len(rows), at_home)))

    for j in range(int(visits[level].max(initial=0))):
        rows = everyone[visits[level] > j]
        give(rows, level[rows], part[rows], np.full(len(rows), j), True)
    for i in range(int(homes[level].max(initial=0))):
        rows = everyone[part > i]
        give(rows, level[rows], np.full(len(rows), i), lot[rows] % visits[level[rows]], False)
    up = everyone[some[level]]
    for i in range(int(homes[level[up] + 1].max(initial=0))):
        rows = up[homes[level[up] + 1] > i]
        give(rows, level[rows] + 1, np.full(len(rows), i), lot[rows] % visits[level[rows] + 1], False)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (everyone, everyone, everyone > 0)


def compare_sets(prints: np.ndarray, sizes: np.ndarray, at_home: np.ndarray, similarity: float, among_home: bool) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of all near pairs of a set at home and a visitor (or another at home)."""
    order = np.argsort(sizes, kind="stable")
    home = order[at_home[order]]
    other = order if among_home else order[~at_home[order]]
    forest, counts = _Forest(len(sizes)), np.bitwise_count(prints[:, :2]).sum(1, dtype=np.int64)
    other_sizes = sizes[other]
    for i in range(0, len(home), 512):
        r = home[i : i + 512]
        first = np.searchsorted(other_sizes, similarity * sizes[r[0]] - 1e-6, "left")
        last = np.searchsorted(other_sizes, sizes[r[-1]] / similarity + 1e-6, "right")
        least, most = counts[r].min(), counts[r].max()
        for j in range(first, last, 512):
            c = other[j : min(j + 512, last)]
            if counts[c].min() - most > NEAR or least - counts[c].max() > NEAR:
                continue
            apart = np.bitwise_count(prints[r, :1] ^ prints[c, 0])
            apart += np.bitwise_count(prints[r, 1:2] ^ prints[c, 1])
            x, y = np.nonzero(apart <= NEAR)
            x, y = r[x], c[y]
            keep = forest.label[x] != forest.label[y]
            x, y = x[keep], y[keep]
            if len(x):
                like = (np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y]) - 1e-6) & (np.bitwise_count(prints[x] ^ prints[y]).sum(1) <= RADIUS)
                forest.link(x[like], y[like])
    return forest.made


def set_links(nodes: DataFrame, similarity: float, home: int = HOME, visit: int = VISIT) -> DataFrame:
    """``a, b``: links of nodes (``node, size, p0..``) that connect all whose fingerprints are near and whose sizes allow the similarity."""
    # Smaller sets are near their equals only, and those are one node.
    some = nodes.where(F.col("size") + 1e-9 >= similarity * (F.col("size") + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, n = np.unique(level_of(batch.column("size").to_numpy(zero_copy_only=False), similarity), return_counts=True)
            yield pa.record_batch([pa.array(level), pa.array(n, pa.int64())], names=["level", "n"])

    # As many rows as sizes have levels: less than a hundred.
    levels = some.select("size").mapInArrow(count, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n"))
    held = {r.level: r.n for r in levels.collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
            task, at, at_home = deal_levels(level_of(batch.column("size").to_numpy(zero_copy_only=False), similarity), node, held, home, visit)
            for i in range(0, len(task), 50_000):
                s = slice(i, i + 50_000)
                rows = batch.take(pa.array(at[s]))
                yield pa.record_batch([pa.array(task[s]), pa.array(at_home[s]), *rows.columns], names=["task", "home", *batch.schema.names])

    def tile(table: pa.Table) -> pa.Table:
        prints = np.stack([table.column(f"p{i}").to_numpy() for i in range(LANES)], axis=1).astype(np.int64).view(_U)
        node, among = table.column("node").to_numpy(), table.column("task")[0].as_py() & 0xFFFFF == 0
        made = compare_sets(prints, table.column("size").to_numpy().astype(np.int64), table.column("home").to_numpy().astype(bool), similarity, among)
        made = np.array(made, np.int64).reshape(-1, 2)
        return pa.table({"a": node[made[:, 0]], "b": node[made[:, 1]]})

    columns = ["node", "size", *(f"p{i}" for i in range(LANES))]
    placed = some.select(columns).mapInArrow(place, f"task bigint, home boolean, node bigint, size int, {_PRINTS}")
    return placed.groupBy("task").applyInArrow(tile, "a bigint, b bigint")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their group of near copies: of smallest id, null last, then of
    smallest text hash.  Near copies are texts whose sets of shingles have at least the Jaccard similarity, and near copies of near
    copies.  One row of each group stays; of rows alike in id and text one stays."""
    keyed = docs.select(row_keys().alias("row"), "text")
    rows = materialize(printed(keyed, shingle), "simhash-sets")
    nodes = rows.drop("row").dropDuplicates(["node"])
    near = components(set_links(nodes, similarity)).distinct()
    groups = materialize(near.withColumnRenamed("root", "group").join(nodes.select("node", "size"), "node"), "simhash-groups")
    roots = components(overlap.links(overlap.texts_of(keyed, groups, shingle), groups, shingle, similarity)).distinct()
    named = rows.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    return keep_first(docs, named)
