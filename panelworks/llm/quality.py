"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Learned filters, each as wide as
``WIDTH`` bytes, run over every position of a chunk; each filter's greatest response is pooled, and a small
dense layer turns the pooled responses into a score for the chunk.  The mean and the greatest and least
of the chunk scores are combined into one probability for the document.

A filter over bytes is a table of weights per (position, byte): a response is a sum of WIDTH table rows, so
no embedding is multiplied out.  Training is plain gradient descent (Adam) with a fixed seed, on a bounded
sample of labelled rows: at most ``sample`` documents, half of each class, drawn by hash over all labelled rows, as many of
them, in the order of the hash, as ``sample_bytes`` hold.  Both learning and scoring read every chunk of a text.

Defined results: null and empty texts are one empty chunk and get that chunk's score; a text shorter than a
chunk is padded; repeated rows score alike; with labelled rows of one class only every score is 0.98 (label 1) or 0.02,
without any 0.5; labels that repeat an id count once, as the greater; rows that repeat a labelled id are drawn like any others, within
the same bound; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, utf8

WIDTH, FILTERS, HIDDEN, CHUNK, STEP = 6, 16, 16, 384, 352
_PAD = 256  # a byte value of its own, with weights of its own: so the network sees where a short text ends


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of n bytes: every STEP, until the rest fits; neighbours overlap."""
    return np.arange(0, max(1, n - CHUNK + STEP), STEP) if n > CHUNK else np.zeros(1, np.int64)


def chunk_rows(data: bytes, starts: np.ndarray) -> np.ndarray:
    x = np.full(max(len(data), int(starts[-1]) + CHUNK), _PAD, np.int16)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    return x[starts[:, None] + np.arange(CHUNK)]


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 257 x FILTERS
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    out: np.ndarray  # weights of mean, max and min of the chunk scores, and a constant

    def responses(self, x: np.ndarray) -> np.ndarray:
        """chunks x positions x FILTERS."""
        n = x.shape[1] - WIDTH + 1
        r = self.tables[0].take(x[:, :n], axis=0)
        for j in range(1, WIDTH):
            r += self.tables[j].take(x[:, j : j + n], axis=0)
        return r

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(greatest responses, where they stand) of chunks x FILTERS."""
        best, place = [], []
        for i in range(0, len(x), 128):
            r = self.responses(x[i : i + 128])
            place.append(r.argmax(1))
            best.append(np.take_along_axis(r, place[-1][:, None], 1)[:, 0])
        return np.concatenate(best), np.concatenate(place)

    def greatest(self, x: np.ndarray) -> np.ndarray:
        return self.responses(x).max(1)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(pooled + self.bias, 0)
        return np.maximum(h @ self.w1 + self.b1, 0) @ self.w2

    def combine(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = np.cumsum(sizes) - sizes
        z = self.out[0] * np.add.reduceat(scores, at) / sizes + self.out[1] * np.maximum.reduceat(scores, at) + self.out[2] * np.minimum.reduceat(scores, at) + self.out[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1, reading every chunk."""
        if not texts:
            return np.empty(0)
        found, sizes = [], []
        held, n = [], 0

        def run():
            found.append(self.scores(self.greatest(np.concatenate(held))))
            held.clear()

        for t in texts:
            starts = chunk_starts(len(t))
            sizes.append(len(starts))
            for i in range(0, len(starts), 128):
                held.append(chunk_rows(t[starts[i] : starts[min(i + 128, len(starts)) - 1] + CHUNK], starts[i : i + 128] - starts[i]))
                n += len(held[-1])
                if n >= 128:
                    run()
                    n = 0
        if held:
            run()
        return self.combine(np.concatenate(found).astype(np.float64), np.array(sizes))


def train(chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, seed: int = 11, steps: int = 800, batch: int = 48, rate: float = 4e-3, pieces: float = 0.15) -> Network:
    """chunks x CHUNK byte values, the document (0..) of each chunk in order, and a 0/1 label per document."""
    rng = np.random.default_rng(seed)
    f = np.float32
    net = Network(
        rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(f),
        np.zeros(HIDDEN, f), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(f), np.array([1.0, 0.3, 0.3, 0.0], f))
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        net.w2[:] = 0
        net.out[:] = [0, 0, 0, 0 if not len(labels) else (4 if share else -4)]
        return net
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(f) ** 0.5
    names = ["tables", "bias", "w1", "b1", "w2", "out"]
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    first = np.searchsorted(owner, np.arange(len(labels) + 1))
    t = 0
    while t < steps:
        for docs in np.array_split(rng.permutation(len(labels)), max(1, -(-len(labels) // batch))):
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            sizes = first[docs + 1] - first[docs]
            at = np.cumsum(sizes) - sizes
            x, part = chunks[rows], np.repeat(np.arange(len(docs)), sizes)
            # Short texts are rare in a sample: some documents come as a short piece of one chunk.  A bad one's ends may be
            # clean, so its piece is from the middle.
            short = np.flatnonzero((rng.random(len(docs)) < pieces) & ((labels[docs] == 1) | (sizes >= 3)))
            if len(short):
                pick = np.array([at[i] + (rng.integers(sizes[i]) if labels[docs[i]] == 1 else sizes[i] // 2) for i in short])
                for i in pick:
                    size = int(rng.integers(16, 160))
                    start = int(rng.integers(0, CHUNK - size)) if x[i, -1] != _PAD else 0
                    x[i, : size] = x[i, start : start + size].copy()
                    x[i, size:] = _PAD
                keep = np.ones(len(x), bool)
                keep[np.isin(part, short)] = False
                keep[pick] = True
                x, part = x[keep], part[keep]
                sizes = np.bincount(part, minlength=len(docs))
                at = np.cumsum(sizes) - sizes
            p, place = net.pooled(x)
            h0 = np.maximum(p + net.bias, 0)
            h1 = np.maximum(h0 @ net.w1 + net.b1, 0)
            s = h1 @ net.w2
            mean, high, low = np.add.reduceat(s, at) / sizes, np.maximum.reduceat(s, at), np.minimum.reduceat(s, at)
            z = net.out[0] * mean + net.out[1] * high + net.out[2] * low + net.out[3]
            dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[docs]) * weight[docs] / len(docs)).astype(f)
            is_high, is_low = s == high[part], s == low[part]
            ds = dz[part] * (net.out[0] / sizes[part] + net.out[1] * is_high / np.add.reduceat(is_high, at)[part] + net.out[2] * is_low / np.add.reduceat(is_low, at)[part])
            dh1 = ds[:, None] * net.w2 * (h1 > 0)
            dh0 = (dh1 @ net.w1.T) * (h0 > 0)
            tables = np.zeros_like(net.tables)
            rows_at, filters = np.arange(len(x))[:, None], np.arange(FILTERS)
            for j in range(WIDTH):
                index = x[rows_at, place + j].astype(np.int64) * FILTERS + filters
                tables[j] = np.bincount(index.ravel(), dh0.ravel(), 257 * FILTERS).reshape(257, FILTERS)
            grads = {"tables": tables + 1e-5 * net.tables, "bias": dh0.sum(0), "w1": h0.T @ dh1, "b1": dh1.sum(0), "w2": h1.T @ ds, "out": np.array([dz @ mean, dz @ high, dz @ low, dz.sum()], f)}
            t += 1
            pace = rate * min(1, t / 30) * (0.5 + 0.5 * np.cos(np.pi * min(1, t / steps)))
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.99 * v[k] + 0.01 * grads[k] ** 2
                getattr(net, k)[...] -= (pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(f)
    return net


def _fold(doc_id):
    """crc32 of the id as text, mod 5."""
    return F.crc32(doc_id.cast("string")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = 2500, sample_bytes: int = 24 << 20) -> DataFrame:
    """``doc_id, text, quality``: whole texts to learn from, none of the held-out fold.  At most sample rows, of sample_bytes together."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    order = [F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id")]

    # A class may be rare: half of the sample from each, as far as there are rows.
    def half(label: int) -> DataFrame:
        return known.where(F.col("quality") == label).orderBy(*order).limit(sample // 2)

    # Rows are chosen by id and length alone; what is sorted and summed in one task is at most sample rows without their texts.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    sized = texts.select("doc_id", size.alias("size"), F.xxhash64("text").alias("hash"))
    drawn = sized.join(F.broadcast(half(0).unionByName(half(1))), "doc_id").orderBy(*order, "hash").limit(sample)
    fits = F.col("size") <= sample_bytes
    so_far = F.sum(F.when(fits, F.col("size")).otherwise(F.lit(0))).over(Window.orderBy(*order, "hash").rowsBetween(Window.unboundedPreceding, 0))
    chosen = drawn.withColumn("so_far", so_far).where(fits & (F.col("so_far") <= sample_bytes)).groupBy("doc_id", "hash", "quality").agg(F.count(F.lit(1)).alias("n"))
    # Of rows that are alike as many are taken as were chosen, and their texts are fetched where they lie.
    alike = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "hash"])
    return alike.groupBy("doc_id", "hash", "quality", "n").agg(F.first("text").alias("text")).select("doc_id", "text", "quality", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2500, sample_bytes: int = 24 << 20, **options) -> Network:
    """A network learned from labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, sample, sample_bytes).collect()
    texts = sorted((r.doc_id, (r.text or "").encode(), r.quality) for r in rows)
    starts = [chunk_starts(len(t)) for _, t, _ in texts]
    chunks = [chunk_rows(t, at) for (_, t, _), at in zip(texts, starts, strict=True)]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in chunks])
    return train(np.concatenate(chunks) if chunks else np.empty((0, CHUNK), np.int16), owner, np.array([q for _, _, q in texts]), **options)


def _scorer(net: Network, docs: DataFrame):
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def scores(column) -> np.ndarray:
        column = utf8(column)
        sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in column]
        found = np.concatenate([np.empty(0), *(sent.value.predict([t.as_py() or b"" for t in column[a:b]]) for a, b in slices(sizes, 1 << 21))])
        return np.round(found, 6)  # what single precision tells, whatever texts are scored together

    return scores


def score(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of docs."""
    scores = _scorer(net, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    scores = _scorer(net, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
