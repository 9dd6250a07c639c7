"""Approximate nearest neighbours by collision-counting hashing.

Each of ``LINES`` random directions gives one projection, and an index block keeps the projections of its vectors as
one sorted array per direction.  A query uses the ``USED`` directions on which its own projection lies farthest out,
since there the projections of its neighbours differ most from those of the rest.  On each it opens a window centred
on its own projection, as wide as a vector at distance R needs to fall inside with probability ``HIT``; virtual
rehashing widens R, and only what wider windows add is counted.  A vector found in the windows of at least a threshold of lines is
verified by its inner product: in single precision first, then in double precision for all within the error of the k-th
best.  As HIT is the same for every R, so is the threshold: a vector at distance R or less misses it with a chance of
about 5 %.  The search of a block ends when the k-th best verified distance is at most R; once k are verified, R goes
no further than that distance.  Windows can grow over everything, so nothing is capped: where few vectors are near, all become
candidates and the search is exact.

Largest inner product is nearest Euclidean neighbour after one more coordinate: with M the greatest norm of
the block, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0) scaled to norm M.  Vectors need not be
normalised, and are scaled before they are squared, so no finite vector is too long or too short.

All rows are indexed, in blocks of about ``block`` rows; queries, a stated set, meet every block in slices of about
``slice_rows``.  Blocks and slices are brought together by one shuffle; no vector passes through the driver.  Every block answers
with its k best per query, and the k best of all blocks are kept.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither as query nor as
candidate; nor do null ids; of vectors of several lengths those of the commonest (of these the longest) take part,
as others have no inner product with them; ties go to the smaller id; rows that repeat an id are candidates each, except for the
query's own id, and one query, for which the least vector stands; a product that overflows comes out infinite, one
that is not a number comes last; with fewer candidates than k all are returned; an empty table gives an empty table; further
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Directions; how many of them a query uses; the chance to be in a window at distance R; standard deviations from the mean of the
#: collisions at that distance to the threshold.
LINES, USED, HIT, SPARE = 512, 64, 0.6, 1.3
#: Least first R, widened by QUICK until windows hold the share FEW of a block; from there on by SLOW.
FIRST, QUICK, SLOW, FEW = 0.2, 1.25, 1.2, 0.12
#: Places of a sorted array where windows may end.
EDGES = 2048
#: Queries prepared at once.
_TOGETHER = 1024
THRESHOLD = int(HIT * USED - SPARE * (USED * HIT * (1 - HIT)) ** 0.5)
_REACH = NormalDist().inv_cdf(HIT)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the greatest magnitude of all, which is left at a value that can be squared."""
    return x / max(float(np.abs(x).max(initial=0.0)), 5e-324)


def window_sizes(centre: np.ndarray, r) -> np.ndarray:
    """Half windows, on lines where a query of norm 1 projects to ``centre``, for distance r.

    On the unit sphere a vector at that distance projects to centre * (1 - r*r/2) plus a normal deviate of
    variance r*r - r**4/4."""
    return np.abs(centre) * (r * r / 2) + _REACH * np.sqrt(np.maximum(r * r - r**4 / 4, 0))


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 3):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        x = scaled(self.x)
        norms = np.einsum("ij,ij->i", x, x)
        top = float(norms.max(initial=0.0)) ** 0.5 or 1.0
        x /= top  # from here on the block lies inside the unit ball
        # Copies in single precision, and twice their greatest error in an inner product of unit vectors.
        self.short = x.astype(np.float32)
        self.margin = 4e-7 * (x.shape[1] + 8)
        self.lines = np.random.default_rng(seed).normal(size=(x.shape[1] + 1, LINES))
        extra = np.sqrt(np.maximum(1 - norms / (top * top), 0))
        projected = (x @ self.lines[:-1] + extra[:, None] * self.lines[-1]).T.copy()
        order = np.argsort(projected, axis=1, kind="stable")
        self.order = order.ravel()
        # Where windows may begin and end: at EDGES places of each sorted array, evenly spaced in the projection.
        self.least, most = float(projected.min(initial=0.0)), float(projected.max(initial=0.0))
        self.scale = (EDGES - 1) / max(most - self.least, 1e-9)
        cell = np.ceil((projected - self.least) * self.scale).astype(np.int64) + EDGES * np.arange(LINES)[:, None]
        below = np.cumsum(np.bincount(cell.ravel(), minlength=EDGES * LINES))
        self.edges = np.concatenate(([0], below))
        self.verified = self.asked = 0

    def _windows(self, line: np.ndarray, centre: np.ndarray, r) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows for distance r, widened to the next edges, start and end in the arrays laid end to end."""
        half = window_sizes(centre, r)
        low = np.clip(np.floor((centre - half - self.least) * self.scale), 0, EDGES).astype(np.int64)
        high = np.clip(np.ceil((centre + half - self.least) * self.scale), -1, EDGES - 1).astype(np.int64)
        at = EDGES * line
        return self.edges[at + low], self.edges[at + np.maximum(low, high + 1)]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, ids, inner products) of the k best found, ties by id."""
        for start in range(0, len(queries), _TOGETHER):
            span = slice(start, start + _TOGETHER)
            for number, ids, products in self._search(queries[span], query_ids[span], k):
                yield start + number, ids, products

    def _search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n = len(self.ids)
        units = queries / np.abs(queries).max(1, keepdims=True)
        units /= np.einsum("ij,ij->i", units, units)[:, None] ** 0.5
        centres = units @ self.lines[:-1]
        used = np.argpartition(-np.abs(centres), USED - 1, axis=1)[:, :USED]
        centres = np.take_along_axis(centres, used, 1)
        first = np.full(len(queries), FIRST)
        narrow = np.arange(len(queries))
        while len(narrow):
            low, high = self._windows(used[narrow], centres[narrow], first[narrow, None])
            narrow = narrow[((high - low).sum(1) < FEW * USED * n) & (first[narrow] < 2)]
            first[narrow] *= QUICK
        owns = np.searchsorted(self.ids, query_ids, "left").tolist(), np.searchsorted(self.ids, query_ids, "right").tolist()
        for number, (unit, line, centre, r, own, behind) in enumerate(zip(units.astype(np.float32), used, centres, first.tolist(), *owns, strict=True)):
            if (want := min(k, n - (behind - own))) <= 0:
                continue
            found, near = self._verified(unit, line, centre, r, own, behind, want)
            # Double precision for all that single precision can't rule out.
            if len(near) > want:
                found = found[near >= np.partition(near, len(near) - want)[len(near) - want] - self.margin]
            with np.errstate(over="ignore", invalid="ignore"):
                # Not a matrix product: equal vectors must get equal values wherever they stand.
                products = np.einsum("ij,j->i", self.x[found], queries[number])
            best = np.lexsort((self.ids[found], -products))[:k]
            yield number, self.ids[found[best]], products[best]

    def _verified(self, unit: np.ndarray, line: np.ndarray, centre: np.ndarray, r: float, own: int, behind: int, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, inner products with the unit query) of the vectors that reach the threshold, and of some more."""
        n = len(self.ids)
        counts = np.zeros(n, np.int64)
        # Those not to be verified (again) are put far below any threshold.
        gone = -(1 << 20)
        counts[own:behind] = gone
        found, near = np.empty(0, np.int64), np.empty(0, np.float32)
        low = high = None
        while True:
            if r >= 2:  # nothing on the sphere lies farther: all the rest
                fresh = np.flatnonzero(counts >= 0)
            else:
                new_low, new_high = self._windows(line, centre, r)
                if low is None:
                    added = [self.order[a:b] for a, b in zip(new_low.tolist(), new_high.tolist(), strict=True)]
                else:
                    added = [self.order[a:b] for a, b in zip(np.concatenate((new_low, high)).tolist(), np.concatenate((low, new_high)).tolist(), strict=True)]
                low, high = new_low, new_high
                counts += np.bincount(np.concatenate(added), minlength=n)
                fresh = np.flatnonzero(counts >= THRESHOLD)
                if len(fresh) < want and len(found) < 4 * want:
                    ahead = np.argpartition(counts, max(0, n - 2 * want))[max(0, n - 2 * want) :]
                    fresh = np.union1d(fresh, ahead[counts[ahead] >= 0])
            counts[fresh] = gone
            found = np.concatenate((found, fresh))
            near = np.concatenate((near, self.short.take(fresh, axis=0) @ unit))
            farthest = 2.0
            if len(found) >= want:
                farthest = max(0.0, 2 - 2 * float(np.partition(near, len(near) - want)[len(near) - want])) ** 0.5
            if r >= 2 or farthest <= r:
                break
            r = min(r * SLOW, max(farthest, r * 1.0001))
        self.verified, self.asked = self.verified + len(found), self.asked + n
        return found, near


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_FOUND = "query_id bigint, vec_id bigint, score double, verified bigint, rows bigint"


def block_answers(vectors: DataFrame, queries, k: int, block: int, slice_rows: int) -> DataFrame:
    """``query_id, vec_id, score``: each block's k best for each query; and on one row of each block and slice of queries how many
    vectors were ``verified``, of how many (``rows``) that were compared by counts."""
    rows = usable(vectors)
    shape = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(queries).alias("q")).orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None or not shape.q:
        return vectors.sparkSession.createDataFrame([], _FOUND)
    rows = rows.where(F.size("v") == shape.d)
    blocks, parts = max(1, -(-shape.n // block)), max(1, -(-shape.q // slice_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select("vec_id", "v", F.lit(True).alias("asks"), each(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    held = rows.select("vec_id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), each(parts).alias("part"))

    def run(table: pa.Table) -> pa.Table:
        ids, asks, v = table.column("vec_id").to_numpy(), table.column("asks").to_numpy().astype(bool), _matrix(table.column("v"))
        found, out = Block(ids[~asks], v[~asks]), []
        if len(found.ids):
            q = ids[asks]
            out = [(np.full(len(near), q[number]), near, products) for number, near, products in found.search(v[asks], q, k)]
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        once = np.arange(len(a)) == 0
        return pa.table({"query_id": a, "vec_id": b, "score": c, "verified": once * found.verified, "rows": once * found.asked})

    # A count that adaptive execution leaves alone: these groups are small in bytes and long in work.
    dealt = held.unionByName(asked).repartition(min(2 * blocks * parts, 10_000), "block", "part")
    return dealt.groupBy("block", "part").applyInArrow(run, _FOUND)


def nearest(vectors: DataFrame, queries, k: int = 20, block: int = 8192, slice_rows: int = 1 << 16) -> DataFrame:
    """``query_id, rank, vec_id, score``.  queries: a condition on ``vec_id`` that states the query set."""
    out = block_answers(vectors, queries, k, block, slice_rows)
    # At most k rows per block for each query.
    order = F.desc(F.nanvl("score", F.lit(float("-inf"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
