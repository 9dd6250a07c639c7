"""Prompts out of call logs, as a batch and as a stream of the same stateless step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def redact(calls: DataFrame, prompt: str = "prompt", digest: str = "prompt_sha256") -> DataFrame:
    """The prompt's SHA-256 in place of the prompt.  Rows without a prompt stay as they are, so a second pass changes nothing."""
    kept = F.col(digest) if digest in calls.columns else F.lit(None).cast("string")
    return calls.withColumn(digest, F.when(F.col(prompt).isNotNull(), F.sha2(prompt, 256)).otherwise(kept)).withColumn(prompt, F.lit(None).cast("string"))


def redaction_counts(calls: DataFrame, prompt: str = "prompt") -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(prompt).isNotNull()).alias("redacted"))
