"""WARC archives: writing pages as records and reading archives back.

Writing.  Records are built by string functions and written through Spark's own file writer, so any
Hadoop file system, its commit protocol and task retries apply.  A record's block is an HTTP response;
of equal payloads of at least ``min_bytes`` the one with the smallest id is a ``response``, the others
are ``revisit`` records without a body that refer to it.  Payloads stay where they are as long as the digests that repeat are few
enough to be sent.  Archives are rotated after ``per_file`` records; with ``compression="gzip"`` an archive is one gzip member.

Reading by boundary-chain verification.  Archives are read in byte ranges, as Spark splits them (a compressed one is a single range),
line by line, so no archive is held whole anywhere.  Whatever their number, each range takes its first record from the chain.

1. Tasks look for the magic of a record anywhere in their range, also inside payloads, and emit a candidate (offset, successor)
   where a header's length leads.  Inside a range pointer jumping leads each candidate to where its chain leaves the range.
2. Pointer jumping over ranges, by joins, from the start of each file, finds where its chain of records enters each range: a magic
   inside a payload is never entered.  A chain that does not end at the last byte of its file is an error.
3. Tasks read their range again from that place on and emit records.  What crosses a border goes on as fragments, which are brought
   together by the end of their record.

Headers may have any length, but may cross one border at most.

Defined results: null html is an empty payload, null url leaves out the target; a null id counts as the
largest, and where all ids of equal payloads are null all are responses; rows that repeat the smallest id
of their payload are all responses; an empty table writes no record and reads back empty; further columns
are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

_END = "\r\n\r\n"
_MAGIC = (b"WARC/1.0\r", b"WARC/1.1\r")
#: Digests that repeat are sent to all tasks up to this many (some 100 bytes each); beyond, payloads are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Ranges of divided archives whose places are sent at once (some 100 bytes each); more take several passes.
RANGES_AT_ONCE = 500_000
_FOUND = {
    "offset": "bigint", "record_id": "string", "record_type": "string", "refers_to": "string", "header_digest": "string", "payload_bytes": "bigint", "payload_digest": "string", "target": "string",
}


def with_types(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to`` (null: a response)."""
    made = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    made = made.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    firsts = (
        made.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    )
    # Only digests that repeat are on the right.  Beyond the bound, a digest with very many rows is split by adaptive execution.
    firsts = materialize(firsts, "warc-firsts")
    joined = made.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts, "payload_digest", "left")
    other = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def record_text(typed: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: a whole record without its closing blank lines."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), clean)).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block,
    ]
    return typed.select(F.concat(*lines).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 100, per_file: int = 2000, compression: str = "gzip") -> None:
    record_text(with_types(pages, min_bytes)).write.option("lineSep", _END).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


# --- Ranges of lines ---------------------------------------------------------------------------------------------------

def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``line, file, block``: the lines of archives without their line feeds, in order within each range of a file."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


class _Range:
    """One range of a file as it comes in batches."""

    def __init__(self, file: int, block: int):
        self.file, self.block, self.size = file, block, 0

    def take(self, lines: pa.Array) -> None:
        raise NotImplementedError

    def close(self) -> list[dict]:
        raise NotImplementedError


def _ranges(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Feeds ranges with their lines and yields what they give, at their end and whenever they have much."""
    at = None
    for batch in batches:
        if not len(batch):
            continue
        file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block"))
        new = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(batch)], strict=True):
            if at is None or (at.file, at.block) != (file[a], block[a]):
                if at is not None:
                    yield pa.RecordBatch.from_pylist(at.close(), schema)
                at = make(int(file[a]), int(block[a]))
            at.take(batch.column("line").slice(a, b - a))
            if len(getattr(at, "rows", ())) >= 1000:
                yield pa.RecordBatch.from_pylist(at.rows, schema)
                at.rows = []
    if at is not None:
        yield pa.RecordBatch.from_pylist(at.close(), schema)


def _joined(lines: pa.Array) -> bytes:
    return b"".join(x + b"\n" for x in lines.to_pylist())


def header_fields(head: bytes) -> dict[str, str]:
    """Names in lower case and values of a header's lines; the first of a name counts."""
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return fields


def successor_of(offset: int, head: bytes) -> int | None:
    """Where the record after one whose header (with its blank line) begins at offset begins."""
    length = header_fields(head).get("content-length", "")
    return offset + len(head) + int(length) + 4 if length.isdigit() else None


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Where the chain of each candidate leaves the candidates, by pointer jumping: the first successor that is none of them."""
    order = np.argsort(offsets, kind="stable")
    starts, leads = offsets[order], successors[order]
    n = len(starts)
    at = np.searchsorted(starts, leads)
    inside = (at < n) & (np.append(starts, -1)[np.minimum(at, n)] == leads)
    jump = np.where(inside, at, np.arange(n))  # a candidate whose chain leaves stays at itself
    while not (jump[jump] == jump).all():
        jump = jump[jump]
    out = np.empty(n, np.int64)
    out[order] = leads[jump]
    return out


_CANDIDATE = "file bigint, block bigint, offset bigint, leaves bigint, size bigint, head binary, lead binary"
_CANDIDATE_ARROW = pa.schema([*((c, pa.int64()) for c in ("file", "block", "offset", "leaves", "size")), ("head", pa.binary()), ("lead", pa.binary())])


class _Candidates(_Range):
    """Candidate records of a range: offsets, and where their chains leave the range.  One row tells the range's size and, where it
    begins with lines that may be the rest of a header, those; one the start of a header that the range does not hold to its end."""

    def __init__(self, file, block):
        super().__init__(file, block)
        self.offsets, self.leaves = [], []
        self.open: list[tuple[int, list[bytes]]] = []  # headers without their blank line so far
        self.lead: list[bytes] | None = [] if block else None
        self.led = b""
        self.before = None  # the line before

    def take(self, lines):
        lengths = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        starts = self.size + np.cumsum(lengths) - lengths
        self.size += int(lengths.sum())
        if self.lead is not None:
            self._led(lines)
        blank = np.flatnonzero(pc.equal(lines, pa.scalar(b"\r", lines.type)).to_numpy(zero_copy_only=False))
        magic = np.flatnonzero(pc.is_in(lines, pa.array(list(_MAGIC), lines.type)).to_numpy(zero_copy_only=False))
        if self.open:
            self._ends(lines, 0, int(blank[0]) if len(blank) else None)
        for i in magic.tolist():
            before = lines[i - 1].as_py() if i else self.before
            if before not in (None, b"\r"):
                continue
            self.open.append((int(starts[i]), []))
            j = int(np.searchsorted(blank, i))
            self._ends(lines, i, int(blank[j]) if j < len(blank) else None)
        self.before = lines[len(lines) - 1].as_py()

    def _ends(self, lines, first: int, last: int | None) -> None:
        """The open header gets its lines up to the blank one, if there is one."""
        offset, held = self.open[-1]
        held += lines.slice(first, (len(lines) if last is None else last + 1) - first).to_pylist()
        if last is not None:
            self.open.pop()
            lead = successor_of(offset, b"".join(x + b"\n" for x in held))
            if lead is not None:
                self.offsets.append(offset)
                self.leaves.append(lead)

    def _led(self, lines) -> None:
        for x in lines.to_pylist():
            if x == b"\r":
                self.led, self.lead = b"".join(y + b"\n" for y in [*self.lead, x]), None
                return
            if not x.endswith(b"\r") or b":" not in x and x[:1] not in b" \t":
                self.lead = None
                return
            self.lead.append(x)

    def close(self):
        leaves = reachable(np.array(self.offsets, np.int64), np.array(self.leaves, np.int64)).tolist()
        told = {"file": self.file, "block": self.block}
        rows = [told | {"offset": a, "leaves": b} for a, b in zip(self.offsets, leaves, strict=True)]
        rows += [told | {"offset": a, "head": b"".join(x + b"\n" for x in held)} for a, held in self.open]
        return [*rows, told | {"size": self.size, "lead": self.led}]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _ranges(batches, _Candidates, _CANDIDATE_ARROW)


def record_of(offset: int, data: bytes) -> dict:
    """A whole record, with its closing blank lines, as a row."""
    body = data.index(b"\r\n\r\n") + 4
    head = header_fields(data[:body])
    http = data.find(b"\r\n\r\n", body, len(data) - 4)
    payload = data[http + 4 : -4] if http >= 0 else data[body:-4]
    header_digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if head.get("warc-type") == "revisit":  # the body is with the record referred to; its length stands in the HTTP header
        told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[body : max(body, http)])
        size, digest = int(told[1]) if told else None, header_digest
    values = (offset, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-refers-to"), header_digest, size, digest, head.get("warc-target-uri"))
    return dict(zip(_FOUND, values, strict=True))


_KINDS = {"bigint": pa.int64(), "string": pa.string()}
_RECORD = "file bigint, " + ", ".join(f"{k} {v}" for k, v in _FOUND.items())
_RECORD_ARROW = pa.schema([("file", pa.int64()), *((k, _KINDS[v]) for k, v in _FOUND.items())])
_PIECE = _RECORD + ", until bigint, piece binary"
_PIECE_ARROW = pa.schema([*_RECORD_ARROW, ("until", pa.int64()), ("piece", pa.binary())])


class _Records(_Range):
    """Records of a range from where its chain enters, and fragments of those that cross its borders.  places: (bytes
    of the file before it, where the first record at or after its start begins, the same for its end)."""

    def __init__(self, file, block, places):
        super().__init__(file, block)
        self.base, self.first, self.next = places[file, block]
        if self.first is None:  # one record lies over all of the range and beyond its file's last border
            raise ValueError("the records of a file do not lead to its end")
        self.rows: list[dict] = []
        self.held: list[bytes] = []
        self.start, self.count = self.base, 0  # where what is held begins, and its bytes
        self.want = self.first - self.base if self.first > self.base else None  # bytes until the next border of records
        self.lead = self.want is not None

    def take(self, lines):
        i, n = 0, len(lines)
        ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        while i < n:
            done = int(ends[i - 1]) if i else 0
            if self.want is None:  # inside a header: up to its blank line
                blank = pc.index(lines.slice(i), pa.scalar(b"\r", lines.type)).as_py()
                self._hold(lines.slice(i, n - i if blank < 0 else blank + 1))
                if blank < 0:
                    return
                i += blank + 1
                head = b"".join(self.held)
                lead = successor_of(0, head) if head.startswith(b"WARC/") else None
                if lead is None:
                    raise ValueError(f"no record at byte {self.start} of a file")
                self.want = lead
                continue
            last = int(np.searchsorted(ends, done + self.want - self.count))
            if last == n:
                self._hold(lines.slice(i))
                return
            self._hold(lines.slice(i, last - i + 1))
            i = last + 1
            if self.count != self.want:
                raise ValueError(f"the record at byte {self.start} of a file does not end with a line")
            self._done()

    def _hold(self, lines) -> None:
        self.held.append(_joined(lines))
        self.count += len(self.held[-1])

    def _done(self) -> None:
        data = b"".join(self.held)
        if self.lead:
            self.rows.append({"file": self.file, "offset": self.start, "until": self.first, "piece": data})
        else:
            if not data.endswith(b"\r\n\r\n"):
                raise ValueError(f"the record at byte {self.start} of a file is not closed")
            self.rows.append({"file": self.file} | record_of(self.start, data))
        self.start, self.held, self.count, self.want, self.lead = self.start + len(data), [], 0, None, False

    def close(self):
        if self.count:
            if self.next is None:
                raise ValueError("the records of a file do not lead to its end")
            self.rows.append({"file": self.file, "offset": self.start, "until": self.first if self.lead else self.next, "piece": b"".join(self.held)})
        return self.rows


def _whole(table: pa.Table) -> pa.Table:
    """The record that some fragments make."""
    table = table.sort_by("offset")
    row = {"file": table.column("file")[0].as_py()} | record_of(table.column("offset")[0].as_py(), b"".join(table.column("piece").to_pylist()))
    return pa.Table.from_pylist([row], _RECORD_ARROW)


def _entries(found: DataFrame) -> DataFrame:
    """``file, block, base, first, next`` of all ranges of divided files, from candidates: by pointer jumping over ranges."""
    in_order = Window.partitionBy("file").orderBy("block")  # as many rows as a file has ranges
    sizes = found.where("size IS NOT NULL")
    base = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.select("file", "block", "size", base.alias("base"), F.lead("lead").over(in_order).alias("behind"), F.sum("size").over(Window.partitionBy("file")).alias("total"))
    blocks = materialize(blocks, "warc-ranges")
    placed = found.where("offset IS NOT NULL").join(blocks.select("file", "block", "base", "behind"), ["file", "block"])
    # A header that crosses a border has its rest at the start of the next range.
    head = F.concat("head", F.coalesce("behind", F.lit(b"")))
    length = F.regexp_extract(F.decode(head, "ISO-8859-1"), r"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", 1).try_cast("bigint")
    leaves = F.coalesce("leaves", F.col("offset") + F.octet_length(head) + length + 4)
    pointers = placed.select("file", (F.col("base") + F.col("offset")).alias("at"), (F.col("base") + leaves).alias("to")).where("to IS NOT NULL")
    # Of all candidates only those matter that a chain may enter.
    entered = pointers.select("file", F.col("to").alias("at")).unionByName(blocks.select("file", F.lit(0).cast("bigint").alias("at"))).distinct()
    pointers = materialize(pointers.join(entered, ["file", "at"], "left_semi"), "warc-pointers")
    reached = blocks.select("file", F.lit(0).cast("bigint").alias("at")).distinct()
    many = blocks.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    step = pointers
    for _ in range(many.bit_length() + 1):
        reached = materialize(reached.unionByName(reached.join(step, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        ahead = step.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        step = materialize(step.join(ahead, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "warc-steps")
    ends = blocks.groupBy("file").agg(F.max("total").alias("at")).where("at > 0").join(reached, ["file", "at"], "left_anti")
    if not ends.isEmpty():
        raise ValueError("the records of an archive do not lead to its end")
    first = reached.join(blocks.select("file", "block", "base", "size"), "file").groupBy("file", "block", "base", "size").agg(
        F.min(F.when(F.col("at") >= F.col("base"), F.col("at"))).alias("first"), F.min(F.when(F.col("at") >= F.col("base") + F.col("size"), F.col("at"))).alias("next"))
    return first.select("file", "block", "base", "first", "next")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that the chain of its archive reaches: ``file`` (a hash of its name), ``offset`` and what the record tells."""
    lines = lines_of(spark, path)
    found = materialize(lines.mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    entries = materialize(_entries(found), "warc-entries")
    passes = max(1, -(-entries.count() // RANGES_AT_ONCE))
    out = None
    for i in range(passes):
        mine = F.pmod("file", F.lit(passes)) == i if passes > 1 else F.lit(True)
        sent = spark.sparkContext.broadcast({(r.file, r.block): (r.base, r.first, r.next) for r in entries.where(mine).toLocalIterator()})

        def records(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return _ranges(batches, lambda file, block: _Records(file, block, sent.value), _PIECE_ARROW)

        part = lines.where(mine).mapInArrow(records, _PIECE)
        part = materialize(part, "warc-records")
        pieces = part.where("until IS NOT NULL").select("file", "offset", "until", "piece")
        part = part.where("until IS NULL").unionByName(pieces.groupBy("file", "until").applyInArrow(_whole, _RECORD), allowMissingColumns=True)
        part = part.select("file", *_FOUND)
        out = part if out is None else out.unionByName(part)
    return out
