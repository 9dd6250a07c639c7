"""A durable log of records: what a task has finished is on disk before it goes on.

A log is a folder of segments, JSON lines, in buckets of keys.  A task appends each record to a segment of its own
and syncs it, so a task that is killed loses the record in hand; another attempt at the same work reads the
segments of earlier attempts and does again only what they lack.  When a job ends, the keys and statuses it
gave are committed beside the log as Parquet, bucket by bucket, with the names of the segments they are in.  What is done in a
bucket is then told by that snapshot, a few bytes a record, and by the *tail*: segments that no job has
committed, left by one that was stopped.  A reader takes no notice of a last line that was cut off.

Segments are written through pyarrow's file systems; where one can't append (object stores), a record is a file of its own.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers, sinks


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, as tasks without a JVM use it, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


class Segment:
    """What one attempt of one task appends to; ``name`` is told with each of its keys."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = opened(folder)
        self.name, self.file, self.written = name, None, 0
        self.fs.create_dir(self.folder, recursive=True)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)

    def append(self, record: dict) -> None:
        self.extend([record])

    def extend(self, records: Sequence[dict]) -> None:
        """Appends records that are finished together: they are synced once."""
        if not records:
            return
        line = "".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in records).encode()
        self.written += 1
        if self.local:
            if self.file is None:
                self.file = open(f"{self.folder}/{self.name}", "ab")  # noqa: SIM115
            self.file.write(line)
            self.file.flush()
            os.fsync(self.file.fileno())
        else:
            with self.fs.open_output_stream(f"{self.folder}/{self.name}-{self.written:06d}.jsonl") as out:
                out.write(line)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


@dataclass(frozen=True)
class Work:
    """Where the tasks of one job append; sent to them."""

    folder: str
    job: str
    keys: tuple[str, ...]

    def segment(self, partition: int, attempt: int) -> Segment:
        return Segment(self.folder, f"{self.job}-{partition:06d}-{attempt:04d}.jsonl")

    def earlier(self, partition: int, attempt: int) -> dict[tuple, tuple[str, str]]:
        """Key -> (status, segment) of what earlier attempts at the same partition have completed."""
        fs, folder = opened(self.folder)
        found = {}
        if attempt:
            for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if info.base_name.startswith(f"{self.job}-{partition:06d}-") and not info.base_name.startswith(f"{self.job}-{partition:06d}-{attempt:04d}"):
                    with fs.open_input_stream(info.path) as lines:
                        for r in whole_records(lines.read()):
                            if r.get("status") == "complete":
                                found[tuple(r[k] for k in self.keys)] = ("complete", info.base_name)
        return found


def whole_records(data: bytes) -> Iterator[dict]:
    """The records of a segment but for a last one that was cut off."""
    lines = data.split(b"\n")
    for line in lines[:-1]:
        if line.strip():
            yield json.loads(line)


class RecordLog:
    """A log under ``path`` of records with the given schema; ``keys`` name a record, ``status`` says how it ended."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), list(keys), schema
        about = f"{self.path}.buckets"
        # As many buckets as when the log was begun: keys stay where they are.
        if readers.exists(spark, about):
            buckets = int(spark.read.text(about).first().value)
        else:
            sinks.put_text(spark, about, f"{buckets}\n")
        self.buckets = buckets

    def bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets))

    def work(self, bucket: int) -> Work:
        return Work(f"{self.path}/bucket={bucket:06d}", uuid.uuid4().hex, tuple(self.keys))

    def _snapshot(self, bucket: int) -> str:
        return f"{self.path}.keys/bucket={bucket:06d}"

    def commit(self, told: DataFrame, bucket: int) -> None:
        """Runs the job that told (keys, status, segment) comes from, and commits what it tells."""
        told.select(*self.keys, "status", "segment").write.mode("append").parquet(self._snapshot(bucket))

    def _segments(self, bucket: int) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket:06d}/*.jsonl")
        return [str(s.getPath()) for s in (p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or [])]

    def told(self, bucket: int) -> DataFrame | None:
        """``keys, status, segment`` of a bucket: its snapshot and its tail.  Reads this bucket alone, and of records only the tail's."""
        snapshot = self._snapshot(bucket)
        held = self.spark.read.parquet(snapshot) if readers.exists(self.spark, f"{snapshot}/_SUCCESS") else None
        # Segments are as many as tasks that have worked on the bucket.
        seen = {r.segment for r in held.select("segment").distinct().collect()} if held is not None else set()
        tail = [p for p in self._segments(bucket) if (name := p.rpartition("/")[2]) not in seen and name.rpartition("-")[0] + ".jsonl" not in seen]
        if tail:
            rest = read_log(self.spark, tail, ", ".join([*(f"{k} string" for k in self.keys), "status string"])).withColumn("segment", F.regexp_extract(F.col("_path"), r"([^/]+)$", 1)).drop("_path")
            held = rest if held is None else held.select(*self.keys, "status", "segment").unionByName(rest)
        return held

    def done(self, bucket: int) -> DataFrame | None:
        """The keys of a bucket's complete records."""
        held = self.told(bucket)
        return None if held is None else held.where("status = 'complete'").select(*self.keys).distinct()

    def records(self, bucket: int | None = None) -> DataFrame | None:
        """Whole records of one bucket, or of all."""
        found = f"{self.path}/*" if bucket is None else f"{self.path}/bucket={bucket:06d}"
        return read_log(self.spark, f"{found}/*.jsonl", self.schema).drop("_path") if readers.exists(self.spark, f"{found}/*.jsonl") else None


def read_log(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Records that were written whole, with ``_path``."""
    lines = spark.read.text(paths).select("value", F.input_file_name().alias("_path")).where(F.trim("value") != "")
    parsed = lines.select("_path", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._corrupt IS NULL").select("_path", "r.*").drop("_corrupt")
