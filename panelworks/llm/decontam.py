"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as words, lower-cased and stripped of characters that are neither letters nor digits; in scripts
written without spaces each character is a word.
A test item of m words may occur with up to k = floor(m * budget) word edits (insertions, deletions,
substitutions).  Split into k + 1 pieces, at least one piece must then stand unchanged, so exact piece
hits, looked up by rolling hashes of all word runs of a piece's length, miss no occurrence.  Around each
hit Myers' bit-parallel algorithm, on words, gives the edit distance of the best place for the item.

The pieces go to every task: they are a stated test set.  It is taken in slices of at most
``slice_words`` words, one pass over the documents for each, so what is sent has a fixed bound whatever
the size of the set.  Documents are never shuffled, and a document that many items hit costs only
its own verifications, one for each item and distinct place.

Defined results: null texts contain nothing; null items, and items without words, are left out; items of fewer
than ``min_words`` words, or whose budget rounds to 0, must occur exactly; repeated items
are matched once, under the smallest id; repeated documents are judged alike; with an empty benchmark
nothing is contaminated; further columns are kept by ``clean`` and left out by ``contamination``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hashed, mix

#: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORDS = re.compile(rf"(?=[^\W_])[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def myers(pattern: list, text: list, anchored: bool = False) -> list[int]:
    """For each end in text, the least edit distance between the pattern and any stretch that ends there; anchored: the stretch that begins
    where text does."""
    m = len(pattern)
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | anchored) & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        out.append(score)
    return out


class Index:
    """Pieces of a slice of items, by length and rolling hash."""

    def __init__(self, items: list[tuple[int, list[str]]], budget: float, min_words: int):
        self.items = items
        self.budgets = [int(len(ws) * budget + 1e-9) if len(ws) >= min_words else 0 for _, ws in items]
        memo = WordHashes()
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for j, (_, ws) in enumerate(items):
            codes = hashed([w.encode() for w in ws], memo)
            k, m = self.budgets[j], len(ws)
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                by_length.setdefault(b - a, []).append((int(runs(codes[a:b], b - a)[0]), j, a))
        self.tables = []
        for length, rows in sorted(by_length.items()):
            rows.sort()
            self.tables.append((length, np.array([r[0] for r in rows], np.uint64), [r[1:] for r in rows]))


def runs(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` codes."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = codes[:n].copy()
    for i in range(1, length):
        out *= _MUL
        out += codes[i : i + n]
    return mix(out)


def start_of(pattern: list, text: list, end: int, distance: int) -> int:
    """Where a stretch begins that ends at end and is that far from the pattern; of several the one of most nearly the pattern's length,
    then the shorter.  The alignment is followed from its end."""
    back = text[max(0, end - len(pattern) - distance) : end][::-1]
    scores = [len(pattern), *myers(pattern[::-1], back, anchored=True)]
    size = min((n for n, d in enumerate(scores) if d == distance), key=lambda n: (abs(n - len(pattern)), n))
    return end - size


def occurrences(index: Index, ws: list[str], memo: WordHashes) -> list[tuple[int, int, int, int, int]]:
    """(item id, distance, start word, end word, words of the item): the best place of each item within its budget."""
    if not ws:
        return []
    codes = hashed([w.encode() for w in ws], memo)
    places: dict[int, set[int]] = {}
    for length, keys, refs in index.tables:
        h = runs(codes, length)
        if not len(h) or not len(keys):
            continue
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        for p in np.flatnonzero(keys[at] == h).tolist():
            q = int(at[p])
            while q < len(keys) and keys[q] == h[p]:
                j, offset = refs[q]
                places.setdefault(j, set()).add(p - offset)
                q += 1
    found = []
    for j, starts in places.items():
        item, ps = index.items[j]
        k, m = index.budgets[j], len(ps)
        best = None
        group: list[int] = []
        for s in [*sorted(starts), None]:
            # Places that lie close together are verified as one stretch.
            if s is not None and (not group or s - group[-1] <= 2 * k + 1):
                group.append(s)
                continue
            low, high = max(0, group[0] - k), min(len(ws), group[-1] + m + k)
            if high > low:
                scores = myers(ps, ws[low:high])
                d = min(scores)
                if d <= k and (best is None or d < best[0]):
                    best = (d, low + scores.index(d) + 1)
            group = [] if s is None else [s]
        if best is not None:
            found.append((item, best[0], start_of(ps, ws, best[1], best[0]), best[1], m))
    return found


def benchmark_slices(benchmark: DataFrame, budget: float, min_words: int, slice_words: int) -> Iterator[Index]:
    """Indexes of the items, each over at most slice_words words (a longer item alone)."""
    rows = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")
    held, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        ws = words(r.text)
        if not ws:
            continue
        if held and size + len(ws) > slice_words:
            yield Index(held, budget, min_words)
            held, size = [], 0
        held.append((r.item_id, ws))
        size += len(ws)
    yield Index(held, budget, min_words)


def contamination(docs: DataFrame, benchmark: DataFrame, budget: float = 0.2, min_words: int = 5, slice_words: int = 2_000_000) -> DataFrame:
    """``doc_id, item_id, distance, item_words, start_word, end_word``: a row per document and item that it contains."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, item_words int, start_word int, end_word int"
    out = None
    for index in benchmark_slices(benchmark, budget, min_words, slice_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            memo = WordHashes()
            for batch in batches:
                ids, found = [], []
                for i, text in enumerate(batch.column("text")):
                    hits = occurrences(sent.value, words(text.as_py()), memo)
                    ids += [i] * len(hits)
                    found += hits
                item, distance, start, end, m = zip(*found, strict=True) if found else ((),) * 5
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(item, pa.int64()), *(pa.array(x, pa.int32()) for x in (distance, m, start, end))],
                    names=["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = 0.2, min_words: int = 5, slice_words: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item.  Rows are judged where they
    stand, so ids may repeat or be null."""
    for index in benchmark_slices(benchmark, budget, min_words, slice_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            memo = WordHashes()
            for batch in batches:
                yield batch.filter(pa.array([not occurrences(sent.value, words(t.as_py()), memo) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
