"""What the operators of this subpackage share: the shared folder, written intermediates, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are ordered: such rows come last.
LAST_ID = (1 << 63) - 1
#: The word pattern of all operators, for Java and RE2 regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z and their lower-case forms, for translate(): other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one on a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(spark, "_panelworks_shared", None):
        spark._panelworks_shared = tempfile.mkdtemp(prefix="panelworks-")
    return spark._panelworks_shared


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here, and a lost
    executor costs no more than a re-read.  Each call has a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_prefix(columns: Iterable[str]) -> str:
    """Underscores that begin none of the columns: names with them clash with no column of a caller."""
    taken = max((len(c) - len(c.lstrip("_")) for c in columns), default=0)
    return "_" * (taken + 1)


#: The type of row_keys().
ROW = "struct<none:boolean,id:bigint,hash:bigint>"


def row_keys():
    """What tells rows of documents apart, as a struct whose order is by id, null last, then by a hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.col("text").isNull(), "text").alias("hash"))


def keep_first(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose key (``row``) is the least of its group in named (``row, root``);
    of rows that are alike in id and text one stays."""
    own = free_prefix(docs.columns)
    names = {k: own + k for k in ("none", "id", "hash")}
    stay = named.groupBy("root").agg(F.min("row").alias("row")).select(*(F.col(f"row.{k}").alias(v) for k, v in names.items()))
    # The same columns for the join and for what follows, so texts are shuffled once.
    keyed = docs.withColumn(own, row_keys()).select(*docs.columns, *(F.col(f"{own}.{k}").alias(v) for k, v in names.items()))
    return keyed.join(stay, [*names.values()], "left_semi").dropDuplicates([*names.values()]).select(*docs.columns)


#: Groups that are joined by broadcast at most, see join_groups().
HEAVY_GROUPS = 20_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """rows (``total`` of them, read twice) joined with groups, which has one row a key and, as ``size``, how many of rows have that key.

    Groups of at least one in HEAVY_GROUPS of all rows are no more than HEAVY_GROUPS and are sent to the rows, which stay where
    they are; the others are small and meet their rows by a shuffle.  So no key brings many rows into one task."""
    heavy = F.col(size) >= max(32, -(-total // HEAVY_GROUPS))
    sent = F.broadcast(groups.where(heavy))
    rest = rows.join(F.broadcast(groups.where(heavy).select(*on)), on, "left_anti")
    return rows.join(sent, on).unionByName(rest.join(groups.where(~heavy), on, how))


def word_count(text):
    """Words of a text column as a bigint column; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


#: Bits of a filter of rows.
FILTER_BITS = 1 << 24


class RowFilter:
    """Which rows may be in a table: no row of it is missed, some others pass.  A bitmap of fixed size, sent to tasks."""

    def __init__(self, table: DataFrame, key):
        """key: a bigint column of table, which spreads evenly."""
        slot = F.pmod(key, F.lit(FILTER_BITS))
        bits = np.zeros(FILTER_BITS, bool)
        made = table.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        for r in made.toLocalIterator():  # of a size that FILTER_BITS fixes
            # Buckets count from one where slots do; slot 0 is in bucket 0.
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little"))
            bits[(at + (r.bucket - 1) * 32768 + 1 if r.bucket else at)] = True
        self.sent = table.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys % FILTER_BITS
        return (self.sent.value[slot >> 3] >> (slot & 7) & 1).astype(bool)

    def __reduce__(self):
        return _filter_of, (self.sent,)


def _filter_of(sent) -> RowFilter:
    made = RowFilter.__new__(RowFilter)
    made.sent = sent
    return made


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hashed(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def utf8(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(sizes, limit: int):
    """(start, end) of consecutive rows whose sizes sum to about the limit; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, for uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
