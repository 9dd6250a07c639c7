"""Token counts of whole texts, as a public tokenizer's library gives them.

A text of up to ``chunk`` bytes is cut at *stable* boundaries and its parts are counted by the library,
with a memo for the parts that come again.  A boundary between two characters is stable where no
piece of the vocabulary holds the two side by side: byte-pair merges only ever join what ends up in one
piece, so no merge crosses it and the two sides encode apart exactly as they do together.  In the model
used here no piece holds a space mark behind another character, so each space that follows a
non-space is stable.

Huge texts are encoded as overlapping chunks with byte offsets.  In an overlap both encodings are
searched for token boundaries that they share and that are stable, between any two characters; the counts are spliced at the
last.  Left of it a chunk is as in the whole text, right of it the next one is, whatever mark the model puts before a chunk.
Where an overlap has no such boundary it is widened, then the chunk, up to the whole rest of the text, so the count is always exact.

Defined results: null counts as the empty text (0 bytes, 0 tokens); strings of special tokens inside a
text are ordinary text; repeated rows are counted alike; a text without spaces is spliced like any other; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_PARTS = re.compile(r" +[^ ]*|[^ ]+")


class Counter:
    """Counts with one sentencepiece model; a worker keeps one for all its tasks."""

    _kept: dict = {}

    def __init__(self, model: str, chunk: int = 1 << 16, overlap: int = 1 << 10, memo: int = 400_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap, self.limit = chunk, overlap, memo
        self.memo: dict[str, int] = {}
        self.longest = 0  # bytes of the longest chunk encoded with offsets
        # Neighbouring characters inside pieces: between any others a boundary is stable.
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i)))
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.spaces_stable = all(pair[1] != MARK or pair[0] == MARK for pair in self.inside)
        # What the model puts before a text, and whether it leaves texts as they are otherwise.
        self.plain = self.sp.encode("a b", out_type=str)[0].startswith(MARK) and self.sp.normalize("a  b ") == MARK + "a" + MARK * 2 + "b" + MARK

    @classmethod
    def of(cls, model: str, **options) -> Counter:
        key = (model, *sorted(options.items()))
        if key not in cls._kept:
            cls._kept[key] = cls(model, **options)
        return cls._kept[key]

    def count(self, text: str) -> int:
        if not (self.spaces_stable and self.plain):
            return len(self.sp.encode(text))
        text = text.replace(MARK, " ")  # the model itself takes the two for one
        if len(text) > self.chunk:
            return self._huge(text.encode())
        return self._small(text)

    def _small(self, text: str) -> int:
        memo = self.memo
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            parts = text.split(" ") if text else []  # the mark that the model puts first stands for the space
        else:
            found = _PARTS.findall(text)
            parts = [p[1:] if i and p[0] == " " else p for i, p in enumerate(found)]
        try:
            return sum([memo[p] for p in parts])
        except KeyError:
            return sum([self._part(p) for p in parts])

    def _part(self, part: str) -> int:
        n = self.memo.get(part)
        if n is None:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            # A lone space mark is what is left of a single space at the end.
            n = len(self.sp.encode(part)) if part else 1
            if len(part) <= 64:
                self.memo[part] = n
        return n

    def _ends(self, data: bytes, start: int, end: int) -> list[int]:
        """Ends of the tokens of data[start:end] encoded alone, as byte offsets into data.  The mark that the model puts first may be a
        token that ends at start."""
        self.longest = max(self.longest, end - start)
        proto = self.sp.encode(data[start:end].decode(), return_type="proto")
        return [start + p.end for p in proto.pieces]

    def _stable(self, data: bytes, at: int) -> bool:
        """Whether no piece spans the boundary before byte ``at``."""
        before = at - 1
        while data[before] & 0xC0 == 0x80:
            before -= 1
        pair = data[before:at].decode() + data[at : _char_end(data, at)].decode()
        return pair.replace(" ", MARK) not in self.inside

    def _huge(self, data: bytes) -> int:
        n, size = len(data), self.chunk
        total, done = 0, -1  # tokens counted, and up to which boundary
        start, end = 0, _char_start(data, min(n, size))
        ends = self._ends(data, start, end)
        while end < n:
            overlap, cut = self.overlap, None
            while True:
                low = _char_start(data, max(start, end - overlap))
                high = _char_start(data, min(n, low + max(size, 2 * overlap)))
                following = self._ends(data, low, high)
                cut = self._splice(data, max(low, done), end, ends, following)
                if cut is not None or low == start:
                    break
                overlap *= 2
            if cut is None:  # nowhere in the whole chunk: it becomes a longer one
                size *= 2
                end = _char_start(data, min(n, start + size))
                ends = self._ends(data, start, end)
                continue
            total += bisect.bisect_right(ends, cut) - bisect.bisect_right(ends, done)
            done, start, end, ends, size = cut, low, high, following, self.chunk
        return total + len(ends) - bisect.bisect_right(ends, done)

    def _splice(self, data: bytes, low: int, end: int, ends: list[int], following: list[int]) -> int | None:
        """The last stable boundary between low and end at which a chunk and the one that follows both end a token."""
        both = set(following)
        for i in range(len(ends) - 1, -1, -1):
            at = ends[i]
            if at <= low:
                return None
            if at < end and at in both and self._stable(data, at):
                return at
        return None


def _char_start(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _char_end(data: bytes, at: int) -> int:
    at += 1
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, **options) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of docs.  ``model`` is a path that executors can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(model, **options)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(counter.count(text))
            made = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
            yield pa.record_batch([batch.column("doc_id"), *made], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
