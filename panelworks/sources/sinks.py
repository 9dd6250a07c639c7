"""Writers: CSV, JSON lines, append-only logs, fingerprints and manifests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from . import readers


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, one_file: bool = False) -> None:
    """With a header.  columns: only these, a missing one as blanks.  Refuses to overwrite."""
    if columns:
        df = df.select(*[blank(c).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    (df.coalesce(1) if one_file else df).write.option("header", True).option("escape", '"').option("emptyValue", "").mode("errorifexists").csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds committed files to a log that is read as JSON lines; nothing written is ever changed."""
    write_jsonl(df, path, "append")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256, bytes`` of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def fingerprint(spark: SparkSession, path: str) -> str | None:
    """The SHA-256 of a file, or of the one file of a folder; of several files that of their digests in order.  Null if there is none."""
    if not readers.exists(spark, path):
        return None
    found = [r.sha256 for r in fingerprints(spark, path).where("NOT startswith(file, '_')").orderBy("file").collect()]
    return found[0] if len(found) == 1 else sha256_text("\n".join(found)) if found else None


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file in place of what is there, through Spark's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # A local file is for others to edit as well, so no checksum of it may stay behind.
    fs.delete(jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.crc"), False)


def bundle_name(team: str, tier: int, entry: str, version: int, part: str | None = None) -> str:
    """The name of a prediction file; part: ``main`` or ``moderator`` for the two files of condition means."""
    return f"{team}_T{tier}_{entry}_v{version}" + (f"_cells_{part}" if part else "") + ".csv"


def upsert_manifest(entries: list[dict], fresh: list[dict]) -> list[dict]:
    """Fresh entries in place of those for the same file; examples go."""
    names = {e["file"] for e in fresh}
    return [e for e in entries if e["file"] not in names and not e["file"].rpartition("/")[2].startswith("example_")] + fresh


def dump(obj) -> str:
    return json.dumps(obj, indent=2, ensure_ascii=False) + "\n"


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: Tier numbers in words, and the name of a creator who has given none.
TIERS = {1: "individual simulation", 2: "group-level reasoning", 3: "direct effect forecast"}
NO_NAME = "Lastname, Firstname"


def orcid_of(text: str | None) -> str | None:
    """The bare id of a valid ORCID, given bare; else nothing."""
    if not text or not re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]", text):
        return None
    total = 0
    for d in text.replace("-", "")[:15]:
        total = (total + int(d)) * 2
    check = (12 - total % 11) % 11
    return text if text[-1] == ("X" if check == 10 else str(check)) else None


def paragraphs(text: str) -> str:
    """Plain text as HTML paragraphs, which blank lines part."""
    return "".join(f"<p>{p.strip()}</p>" for p in re.split(r"\n[ \t]*\n", text.strip()))


def citation(meta: dict, collection: str = "Survey predictions", keywords: Sequence[str] = (), related: Sequence[dict] = ()) -> dict:
    """A deposit's citation record from its metadata: creators (with valid ids only), the abstract or a description made from the
    other fields, licence, version, and the code it was made with.  An error without a team."""
    team = meta.get("team_id")
    if not team:
        raise ValueError("the metadata name no team_id")
    tier = meta.get("tier")
    tier = int(tier) if str(tier).isdigit() else None
    kind = TIERS.get(tier, "submission")
    creators = []
    for c in meta.get("creators") or [{"affiliation": "Your institution"}]:
        person = {"name": c.get("name") or NO_NAME}
        if c.get("affiliation"):
            person["affiliation"] = c["affiliation"]
        if orcid := orcid_of(c.get("orcid")):
            person["orcid"] = orcid
        creators.append(person)
    cover = meta.get("coverage") or {}
    made = (f"<p>Tier {tier} ({kind}) submission to {collection} (team <code>{team}</code>).</p><p>Approach family: {meta.get('approach_family') or 'see the registration form'}. Model(s): {', '.join(meta.get('models') or [])}. "
            f"Coverage: {cover.get('interventions', 16)} interventions by {cover.get('outcomes', 13)} outcomes.</p><p>This record holds the prediction file(s), the code that made them and the registration form.</p>")
    abstract = meta.get("abstract") or ""
    links, code = list(related), meta.get("code_repository") or ""
    if code and "your-team/your-repo" not in code:
        links.append({"identifier": code, "relation": "isCompiledBy", "scheme": "url", "resource_type": "software"})
    record = {
        "upload_type": "software", "title": f"{collection}: Tier {tier} ({kind}) submission (team {team})", "version": f"1.0-t{tier}", "language": "eng",
            "access_right": "open", "license": meta.get("license") or "CC-BY-4.0",
        "creators": creators, "description": paragraphs(abstract) if abstract.strip() else made, "keywords": list(keywords), "related_identifiers": links,
        "notes": f"Team {team}. Disclosure class {meta.get('disclosure_class') or 'A'}.",
    }
    return {k: v for k, v in record.items() if v != []}


def citations(deposits: DataFrame, **options) -> DataFrame:
    """citation() of many deposits: ``id, metadata`` (JSON) -> ``id, record`` (JSON; null where the metadata name no team)."""

    @F.pandas_udf("string")
    def records(meta: pd.Series) -> pd.Series:
        told = [json.loads(m) if m else {} for m in meta]
        return pd.Series([json.dumps(citation(m, **options), ensure_ascii=False) if m.get("team_id") else None for m in told], dtype=object)

    return deposits.select("id", records("metadata").alias("record"))
