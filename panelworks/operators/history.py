"""Post and comment exports to one history table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

COLUMNS = ["post_type", "id", "author", "author_created_utc", "subreddit", "created_utc", "title", "body", "score", "link_id", "parent_id"]
#: Names under which a column may come; the first that is there counts.
ALIASES = {"body": ["body", "text", "selftext"], "created_utc": ["created_utc", "created"], "id": ["id", "post_id", "comment_id"], "score": ["score", "ups"]}


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    by_lower = {}
    for c in columns:
        by_lower.setdefault(c.lower(), c)
    return next((by_lower[x.lower()] for x in candidates if x.lower() in by_lower), None)


def align(raw: DataFrame, post_type: str, author_column: str = "author_key") -> DataFrame:
    """An export in the history's columns; what it lacks is blank."""
    def source(name: str):
        wanted = [author_column, "author"] if name == "author" else ALIASES.get(name, [name])
        found = find_column(raw.columns, wanted)
        return F.lit("") if found is None else X.blank(F.col(f"`{found}`"))

    made = {n: source(n) for n in COLUMNS if n != "post_type"} | {"post_type": F.lit(post_type)}
    made["author"] = X.key(made["author"])
    return raw.select(*[made[n].alias(n) for n in COLUMNS])


def column_report(raw: DataFrame, author_column: str = "author_key") -> dict[str, str]:
    """Where each column of the history comes from; blank where the export lacks it."""
    return {n: find_column(raw.columns, [author_column, "author"] if n == "author" else ALIASES.get(n, [n])) or "" for n in COLUMNS if n != "post_type"}


def dedup_first(df: DataFrame, key: str, order: Sequence, keep_blank: bool = True) -> DataFrame:
    """The first row of each key by the order.  Rows with a blank key are all kept, since a missing key identifies nothing."""
    known = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    # An aggregate, so tasks combine what they have and a key of very many rows isn't sorted in one place.
    first = known.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("_first"))
    first = first.select(*[key if c == key else F.col("_first").getField(c).alias(c) for c in df.columns])
    return first.unionByName(df.where(F.col(key).isNull() | (F.col(key).cast("string") == ""))) if keep_blank else first


def build_history(submissions: Sequence[DataFrame], comments: Sequence[DataFrame], author_column: str = "author_key") -> DataFrame:
    """All exports together, repeated ids once; earlier files win, submissions before comments."""
    out = None
    for n, (raw, kind) in enumerate([*((s, "submission") for s in submissions), *((c, "comment") for c in comments)]):
        part = align(raw, kind, author_column).withColumns({"_file": F.lit(n), "_seq": F.monotonically_increasing_id()})
        out = part if out is None else out.unionByName(part)
    return dedup_first(out, "id", ["_file", "_seq"]).drop("_file", "_seq")


def inference_pool(history: DataFrame) -> DataFrame:
    """Submissions, and comments that answer a submission."""
    return history.where((F.col("post_type") == "submission") | ((F.col("post_type") == "comment") & F.startswith(X.blank("parent_id"), F.lit("t3_"))))
