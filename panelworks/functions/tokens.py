"""Byte-pair token counts: a vocabulary of ranks is a parameter, words are merged by rank and remembered.

A text is cut into words by the vocabulary's pattern; a word's bytes are joined pair by pair, the pair of least rank first and
of equal ones the first, until no pair is in the vocabulary.  ``text.token_estimate`` is the rule where there is no vocabulary.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources import readers
from .text import blank

#: Fixed value: how byte-level vocabularies of the first kind cut texts into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers, and the longest that it does (in bytes).
MEMO, MEMO_BYTES = 200_000, 64


def read_ranks(text: str) -> dict[bytes, int]:
    """Lines of a piece in base 64 and its rank."""
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in text.splitlines() if line.strip())}


def pieces(word: bytes, ranks: dict[bytes, int]) -> int:
    """Into how many pieces a word falls.  Pairs wait in a heap, so a word of n bytes takes n log n steps."""
    if word in ranks or len(word) < 2:
        return min(1, len(word))
    ends = list(range(1, len(word) + 1))  # where the piece that begins at a place ends; 0: no piece begins there
    before = list(range(-1, len(word) - 1))

    def pair(a: int):
        b = ends[a]
        if b < len(word) and (rank := ranks.get(word[a : ends[b]])) is not None:
            heapq.heappush(heap, (rank, a, b, ends[b]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(len(word) - 1):
        pair(i)
    left = len(word)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if ends[a] != b or b >= len(word) or ends[b] != end:
            continue  # one of the two has been joined with another meanwhile
        ends[a], ends[b] = end, 0
        left -= 1
        if end < len(word):
            before[end] = a
        pair(a)
        if before[a] >= 0:
            pair(before[a])
    return left


class Counter:
    """Counts the tokens of texts, in a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORDS):
        import regex

        self.ranks, self.words, self.memo = ranks, regex.compile(pattern), {}

    def word(self, word: str) -> int:
        if (n := self.memo.get(word)) is None:
            data = word.encode()
            n = pieces(data, self.ranks)
            if len(data) <= MEMO_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = n
        return n

    def count(self, text: str) -> int:
        return sum(self.word(m.group()) for m in self.words.finditer(text))


def token_counter(spark: SparkSession, path: str, pattern: str = WORDS) -> Callable[[Column | str], Column]:
    """A function from a text column to its token counts (null: 0), for the vocabulary at path.  The vocabulary is sent to tasks once."""
    sent = spark.sparkContext.broadcast(read_ranks(readers.read_text(spark, path)))

    @pandas_udf("bigint")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(sent.value, pattern)
        for batch in batches:
            yield batch.map(counter.count)

    return lambda x: counts(blank(x)) if x is not None else F.lit(0)
