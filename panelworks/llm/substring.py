"""Substring deduplication by recompression.

A window is ``size`` consecutive words of a document.  A word is removed where a window that covers it
also starts earlier: in a document of smaller id, or earlier in the same one.

Recompression.  A document is a string of symbols, first its words.  A round names maximal runs of one
symbol, then pairs whose left symbol falls into one half of the alphabet and whose right symbol falls
into the other.  A name is a 64-bit hash of what it stands for, so all tasks give equal strings equal names, everywhere: naming
itself needs no shuffle.  A round shortens strings by a quarter, and after some thirty most documents are one symbol.  Symbols inside
a repeated passage are the same in all of its copies; only those near its rim differ.

The operator works down from high symbols to single windows, in three Spark rounds, each an exchange by name:

1. *Long repeats.*  Symbols of at least ``size`` words, from round ``LOWEST`` up to the last: a passage of a thousand words sends a few
   dozen rows, the longest of hundreds of words.  A second hash of the words verifies a name.  In all but its first occurrence
   every window inside the symbol repeats, and nothing below it is looked at again.
2. *Anchors* of all other windows.  For each symbol of the first rounds its *context* is kept: the words that its making
   depended on.  In each window the symbol of highest level whose context fits at least ``left`` words behind
   and ``right`` words ahead of its start is chosen, ties by name, then the first.  The choice depends on the
   window's words alone, so equal windows choose equal anchors at equal offsets, and neighbouring windows
   mostly share one: about one anchor in six words.  All words that an anchor's windows cover are hashed (its name and this
   stretch hash together make 128 bits).  Equal stretches form a class.  In all but its first occurrence every
   window repeats.  A name that occurs in one class only is done with.
3. *Windows* of first occurrences whose name has several classes (the rims of repeats) are compared one by
   one by 128-bit hashes.

All rounds bring rows together by key after tasks have combined their own: of equal keys a task sends on one,
so no key is hot.  What is broadcast is a filter of fixed size, and nothing else is collected.  Texts go through one exchange, those with
long repeats through another before; they are handled in blocks of words.

Defined results: null text has no words; a null id comes after all ids (rows with null ids count as one
document); rows that repeat an id count as one document, told apart by their texts, and identical rows are
treated alike, neither removing the other; documents shorter than a window keep all words; an empty
table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, RowFilter, WordHashes, hashed, materialize, mix, slices, utf8

_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_FAR = 1 << 40
_SPACE = re.compile(rb"[ \t-\r]")
#: Words handled at once (arrays of a few megabytes), what a block of a longer text looks at on either side, and bytes split at once.
_AT_ONCE, _MARGIN, _BYTES = 200_000, 128, 1 << 22
#: Rounds after which symbols are sent: the first, every so many, the last.
LOWEST, STEP, LAST = 12, 5, 42


class _Powers:
    """Powers of odd multipliers and of their inverses modulo 2**64."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.tables = []
            for m in (_M1, _M2):
                inverse = _U(pow(int(m), -1, 1 << 64))
                self.tables.append([np.cumprod(np.concatenate(([_U(1)], np.full(self.n, x, _U))), dtype=_U) for x in (m, inverse)])
        return self.tables


class Stretches:
    """Hashes of any stretch of a string of codes."""

    def __init__(self, codes: np.ndarray, powers: _Powers):
        n = len(codes)
        self.sums, self.inverse = [], []
        for lane, (power, inverse) in enumerate(powers.upto(n)):
            values = (codes if lane == 0 else mix(codes ^ _M2)) * power[:n]
            self.sums.append(np.concatenate(([_U(0)], np.cumsum(values, dtype=_U))))
            self.inverse.append(inverse)

    def hash(self, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        s = self.sums[lane]
        return mix((s[end] - s[start]) * self.inverse[lane][start] + (end - start).astype(_U))


def merged(name: np.ndarray, own: np.ndarray, r: int):
    """Round r over a string of symbols: (where runs begin, their lengths, names of runs, right halves, which runs are a pair with the
    next, which are the second of one, which are followed by one of the same document, names).  own numbers each symbol's document."""
    # Runs.
    first = np.empty(len(name), bool)
    first[:1] = True
    first[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(name)))
    runs = np.where(length > 1, mix(name[at] * _M1 + length.astype(_U) + _U(2 * r)), name[at])
    own = own[at]
    same = own[1:] == own[:-1]
    # Pairs: left half, then right half.
    right = (mix(runs + _U(r * int(_M2) % (1 << 64))) >> _U(63)).astype(bool)
    paired = np.zeros(len(runs), bool)
    paired[:-1] = ~right[:-1] & right[1:] & same
    second = np.zeros(len(runs), bool)
    second[1:] = paired[:-1]
    new = runs.copy()
    p = np.flatnonzero(paired)
    new[p] = mix(mix(runs[p]) * _M1 + runs[p + 1] + _U(2 * r + 1))
    return at, length, right, paired, second, same, new


def levels(codes: np.ndarray, doc: np.ndarray, rounds: int):
    """(start, name, context start, context end) of the symbols that each round makes, words first.  doc numbers
    the document of each word; no symbol and no context crosses from one to another."""
    n = len(codes)
    index = np.arange(n, dtype=np.int64)
    name, start, low, high, own = mix(codes), index, index, index + 1, doc
    yield start, name, low, high
    for r in range(1, rounds + 1):
        at, length, right, paired, second, same, new = merged(name, own, r)
        # Where a run starts and ends depends on the symbol before it and the one behind it.
        low = np.concatenate(([-_FAR], np.where(same, low[at[1:] - 1], -_FAR)))
        high = np.concatenate((np.where(same, high[at[1:]], _FAR), [_FAR]))
        new_low, new_high = low.copy(), high.copy()
        p = np.flatnonzero(paired)
        new_high[p] = high[p + 1]
        # A symbol left alone depends on the neighbour that did not match it.
        alone_left = np.flatnonzero(~paired & ~right)
        new_high[alone_left] = np.where(alone_left + 1 < len(new), np.append(high[1:], _FAR)[alone_left], _FAR)
        alone_right = np.flatnonzero(right & ~second)
        new_low[alone_right] = np.where(alone_right > 0, np.concatenate(([-_FAR], low[:-1]))[alone_right], -_FAR)
        keep = ~second
        name, start, low, high, own = new[keep], start[at][keep], new_low[keep], new_high[keep], own[at][keep]
        made = ((length > 1) | paired)[keep]
        yield start[made], name[made], low[made], high[made]


def high_symbols(codes: np.ndarray, doc: np.ndarray, size: int):
    """(start, end, name, document) arrays of the symbols of at least size words, after each of the rounds that send; a symbol that
    stays the same is given once."""
    name, start, own = mix(codes), np.arange(len(codes), dtype=np.int64), doc
    fresh = np.ones(len(codes), bool)
    for r in range(1, LAST + 1):
        at, length, _, paired, second, _, new = merged(name, own, r)
        keep = ~second
        fresh = (fresh[at] | (length > 1) | paired)[keep]
        name, start, own = new[keep], start[at][keep], own[at][keep]
        if r == LAST or (r >= LOWEST and (r - LOWEST) % STEP == 0):
            end = np.append(start[1:], len(codes))
            some = np.flatnonzero(fresh & (end - start >= size))
            yield start[some], end[some], name[some], own[some]
            fresh[:] = False


def anchors(codes: np.ndarray, sizes: np.ndarray, powers: _Powers, size: int, left: int = 3, right: int = 7, rounds: int = 3):
    """(document number, name, anchor word, first window, windows, stretch hash) arrays; words count from 0 over all
    documents together.  sizes: words of each document."""
    n = len(codes)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.zeros(n, _U)
    for level, (start, name, low, high) in enumerate(levels(codes, doc, rounds)):
        fits = (start - low <= left) & (high - start <= right) if level else slice(None)
        rank[start[fits]] = (name[fits] >> _U(3)) | (_U(level) << _U(61))
    n_windows = n - size + 1
    if n_windows <= 0:
        return None
    best, place = rank[left : left + n_windows].copy(), np.zeros(n_windows, np.int64)
    for d in range(1, size - left - right + 1):
        other = rank[left + d : left + d + n_windows]
        better = other > best
        best[better] = other[better]
        place[better] = d
    window = np.flatnonzero(doc[:n_windows] == doc[size - 1 :])
    if not len(window):
        return None
    at = window + left + place[window]
    new = np.empty(len(window), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    first, at = window[head], at[head]
    s = Stretches(codes, powers)
    # The name with its surroundings, all inside each window, so that few names meet by chance.
    name = mix(s.hash(at - left, at + right) + rank[at])
    stretch = mix(s.hash(first, first + count - 1 + size) + ((at - first) * 64 + count).astype(_U))
    return doc[first], name, at, first, count, stretch, ends - sizes


def _split(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, from some megabytes at a time."""
    start = 0
    while start < len(text):
        end = start + _BYTES
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        yield text[start:end].split()
        start = end


class _Block:
    """Words of some documents, or of a stretch of a long one."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, sizes: np.ndarray, skipped: int = 0, low: int = 0, high: int = _FAR):
        #: Rows of the batch, hashes of all their words, words per row, words of the (one) row before the block, and between which of its words
        #: windows that belong to the block begin.
        self.rows, self.codes, self.sizes, self.skipped, self.low, self.high = rows, codes, sizes, skipped, low, high
        self.begin = np.cumsum(sizes) - sizes - skipped
        self.doc = np.repeat(np.arange(len(sizes)), sizes)


def _blocks(batch: pa.RecordBatch, memo: WordHashes) -> Iterator[_Block]:
    column = utf8(batch.column("text"))
    lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in column]
    for a, b in slices(lengths, 6 * _AT_ONCE):
        of_row = [[hashed(ws, memo) for ws in _split(t.as_py() or b"")] for t in column[a:b]]
        sizes = np.array([sum(map(len, x)) for x in of_row], np.int64)
        codes = np.concatenate([np.empty(0, _U), *(c for x in of_row for c in x)])
        if not len(codes):
            continue
        if len(codes) <= 2 * _AT_ONCE or b - a > 1:
            yield _Block(np.arange(a, b), codes, sizes)
            continue
        for i in range(0, len(codes), _AT_ONCE):
            low, high = max(0, i - _MARGIN), min(len(codes), i + _AT_ONCE + _MARGIN)
            yield _Block(np.array([a]), codes[low:high], np.array([high - low]), low, i, i + _AT_ONCE)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("version"), "doc_id", "text")


class _Combiner:
    """Rows (two keys, document, version, first window, windows) on their way to an exchange by key.  Of rows with equal keys
    in a task only the first place goes there; the others are known to repeat and carry a scattered key instead, so
    a passage of very many copies is spread evenly."""

    names = ["key", "key2", "doc", "version", "first", "count", "repeats"]
    kinds = "key bigint, key2 bigint, doc bigint, version bigint, first int, count int, repeats boolean"

    def __init__(self, limit: int = 1 << 19):
        self.limit, self.parts, self.held = limit, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        key, key2, doc, version, first, count = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.lexsort((first, doc, key2, key))
        key, key2, doc, version, first, count = (c[order] for c in (key, key2, doc, version, first, count))
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        repeats = (doc != doc[lead]) | (first != first[lead])
        key = np.where(repeats, mix(doc.view(_U) * _M1 + first.astype(_U)), key)
        key2 = np.where(repeats, _U(0), key2)
        for i in range(0, len(key), 1 << 17):
            s = slice(i, i + (1 << 17))
            places = [pa.array(x[s].astype(np.int32)) for x in (first, count)]
            yield pa.record_batch([_signed(key[s]), _signed(key2[s]), pa.array(doc[s]), pa.array(version[s]), *places, pa.array(repeats[s])], names=self.names)


def _resolve(rows: DataFrame) -> DataFrame:
    """rows of a combiner, brought together by key, with ``repeats`` settled over all tasks."""
    lead = F.min(F.struct("doc", "first")).over(Window.partitionBy("key", "key2", "repeats"))
    rows = rows.repartition("key").withColumn("lead", lead)
    return rows.withColumn("settled", F.col("repeats") | (F.struct("doc", "first") > F.col("lead"))).drop("lead")


def _spans(batch: pa.RecordBatch, column: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) arrays of a row's list of spans."""
    held = batch.column(column)[row]
    if not held.is_valid or not len(held.values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(held.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "count"))


def _covered(first: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Which of the numbers below n are in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(first, 0, n), 1)
    np.add.at(edge, np.clip(first + count, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version")]


def long_repeats(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a combiner for the high symbols of rows (``doc, version, text``), with ``settled``: not the first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, powers, out = WordHashes(), _Powers(), _Combiner()
        for batch in batches:
            doc, version = _ids(batch)
            for block in _blocks(batch, memo):
                words = Stretches(block.codes, powers)
                for start, end, name, own in high_symbols(block.codes, block.doc, size):
                    row = block.rows[own]
                    yield from out.add(name, words.hash(start, end), doc[row], version[row], start - block.begin[own], end - start - size + 1)
        yield from out.flush()

    return _resolve(rows.select("doc", "version", "text").mapInArrow(run, _Combiner.kinds))


def deduplicate(docs: DataFrame, size: int = 20, text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the words left, if ``text``) of every row of docs."""
    if not 12 <= size <= 60:
        raise ValueError("windows of 12 to 60 words")
    rows = _named(docs)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, powers, out = WordHashes(), _Powers(), _Combiner()
        for batch in batches:
            doc, version = _ids(batch)
            for block in _blocks(batch, memo):
                if (found := anchors(block.codes, block.sizes, powers, size)) is None:
                    continue
                number, name, _, first, count, stretch, _ = found
                # Windows inside long repeats are settled; an anchor with others is sent whole.
                settled = np.zeros(len(block.codes) + 1, bool)
                for i, row in enumerate(block.rows.tolist() if "long" in batch.schema.names else []):
                    a, c = _spans(batch, "long", row)
                    if len(a):
                        at = block.begin[i] + block.skipped
                        settled[at : at + block.sizes[i]] = _covered(a - block.skipped, c, int(block.sizes[i]))
                before = np.concatenate(([0], np.cumsum(settled)))
                place = first - block.begin[number]
                some = np.flatnonzero((before[first + count] - before[first] < count) & (place + count > block.low) & (place < block.high))
                row = block.rows[number[some]]
                yield from out.add(name[some], stretch[some], doc[row], version[row], place[some], count[some])
        yield from out.flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, powers, out = WordHashes(), _Powers(), _Combiner()
        for batch in batches:
            doc, version = _ids(batch)
            for block in _blocks(batch, memo):
                number, at = [], []
                for i, row in enumerate(block.rows.tolist()):
                    first, count = _spans(batch, "found", row)
                    own = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    own = own[(own >= block.low) & (own < block.high)]
                    at.append(own)
                    number.append(np.full(len(own), i))
                number, at = np.concatenate(number), np.concatenate(at)
                start, words, row = at + block.begin[number], Stretches(block.codes, powers), block.rows[number]
                yield from out.add(words.hash(start, start + size), words.hash(start, start + size, 1), doc[row], version[row], at, np.ones(len(at), np.int64))
        yield from out.flush()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept = [], [], [], []
            for row, t in enumerate(utf8(batch.column("text"))):
                first, count = _spans(batch, "spans", row)
                gone = _covered(first, count - 1 + size, int((first + count).max(initial=0)) - 1 + size)
                n, left, digest, texts = 0, 0, hashlib.sha256(), []
                for ws in _split(t.as_py() or b""):
                    here = gone[n : n + len(ws)]
                    n += len(ws)
                    if here.any():
                        ws = list(compress(ws, [*(~here).tolist(), *[True] * (len(ws) - len(here))]))
                    if ws:
                        joined = b" ".join(ws) if not left else b" " + b" ".join(ws)
                        left += len(ws)
                        digest.update(joined)
                        if text:
                            texts.append(joined)
                n_words.append(n)
                n_removed.append(n - left)
                digests.append(digest.hexdigest())
                kept.append(b"".join(texts).decode())
            made = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if text:
                made["kept"] = pa.array(kept, pa.string())
            yield pa.record_batch(list(made.values()), names=list(made))

    span = F.struct("first", "count")
    long = long_repeats(rows, size).where("settled").groupBy("doc", "version").agg(F.collect_set(span).alias("long"))
    long = materialize(long, "substring-long")
    # Documents without long repeats stay where they are.
    place = F.xxhash64("doc", "version")
    has_long = RowFilter(long, place)

    def chosen(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(has_long(batch.column("place").to_numpy(zero_copy_only=False)) == wanted)).drop_columns(["place"])

        return run

    placed = rows.select("doc", "version", "text", place.alias("place"))
    some = placed.mapInArrow(chosen(True), "doc bigint, version bigint, text string").join(long, ["doc", "version"], "left")
    found = some.mapInArrow(anchored, _Combiner.kinds).unionByName(placed.mapInArrow(lambda batches: anchored(chosen(False)(batches)), _Combiner.kinds))
    of_name = Window.partitionBy("key", "repeats")
    found = _resolve(found)
    found = found.withColumn("several", ~F.col("settled") & (F.min("key2").over(of_name) != F.max("key2").over(of_name)))
    found = materialize(found.where("settled OR several").select("doc", "version", "first", "count", "settled"), "substring-stretches")
    # Both joins below read one and the same exchange of the texts, hence the same columns in both.
    by_text = rows.repartition("doc", "version")
    leads = found.where("NOT settled").groupBy("doc", "version").agg(F.collect_set(span).alias("found"))
    compared = _resolve(by_text.join(leads, ["doc", "version"]).select("doc", "version", "doc_id", "text", "found").mapInArrow(windows, _Combiner.kinds))
    places = ["doc", "version", "first", "count"]
    repeated = found.where("settled").select(places).unionByName(compared.where("settled").select(places))
    repeated = repeated.unionByName(long.select("doc", "version", F.inline("long")))
    spans = repeated.groupBy("doc", "version").agg(F.collect_set(span).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if text else "")
    return by_text.join(spans, ["doc", "version"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
