"""Checks of analytic tables.  Each gives ``check, status, detail`` rows; the verdict is the worst status."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recode as R
from ..functions import vocab
from ..scratch import written
from ..sources import readers, sinks
from .tiers import TIER1, TRUST_NAMES

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
_RANK = {PASS: 0, WARN: 1, FAIL: 2}


class Report:
    def __init__(self):
        self.rows: list[tuple[str, str, str]] = []

    def add(self, check: str, ok: bool, detail: str = "", otherwise: str = FAIL) -> bool:
        self.rows.append((check, PASS if ok else otherwise, "" if ok else detail))
        return ok

    @property
    def verdict(self) -> str:
        return max((s for _, s, _ in self.rows), key=_RANK.get, default=PASS)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "check string, status string, detail string")

    def text(self) -> str:
        return "\n".join([*(f"{s:4} {c}" + (f": {d}" if d else "") for c, s, d in self.rows), f"verdict: {self.verdict}"]) + "\n"


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n, n_distinct, n_duplicates`` of key combinations."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*keys)).alias("n_distinct")).withColumn("n_duplicates", F.col("n") - F.col("n_distinct"))


def out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column how many values are missing and how many lie outside its range."""
    checks = [x for c, (lo, hi) in ranges.items() for x in (F.count_if(R.number(c).isNull()).alias(f"{c}|missing"), F.count_if(~R.number(c).between(lo, hi)).alias(f"{c}|outside"))]
    one = df.agg(*checks)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|missing`").alias("missing"),
        F.col(f"`{c}|outside`").alias("outside")) for c in ranges])).alias("r")).select("r.*")


def grid_completeness(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``cells, expected, duplicated, complete``: each combination of the levels that occur, once."""
    counted = df.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(F.struct(*dims)).alias("distinct_cells"), *[F.count_distinct(d).alias(f"n_{d}") for d in dims])
    expected = F.lit(1).cast("bigint")
    for d in dims:
        expected = expected * F.col(f"n_{d}")
    return counted.select("cells", expected.alias("expected"), (F.col("cells") - F.col("distinct_cells")).alias("duplicated"),
        ((F.col("cells") == F.col("distinct_cells")) & (F.col("cells") == expected)).alias("complete"))


def unknown_labels(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(known))).select(F.col(column).alias("label")).distinct()


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"))


def _columns(r: Report, df: DataFrame, wanted: Sequence[str]) -> bool:
    lacking = [c for c in wanted if c not in df.columns]
    return r.add("columns", not lacking, f"missing {lacking}")


#: Unknown labels that a report shows; how many there are never matters to its verdict.
SHOWN = 20


def _unknown(df: DataFrame, column: str, known: Sequence[str]) -> list[str]:
    """Some of the labels that are not known; empty only if there is none."""
    return sorted(str(x.label) for x in unknown_labels(df, column, known).limit(SHOWN).collect())


def _labels(r: Report, df: DataFrame, column: str, known: Sequence[str], all_wanted: bool = True) -> None:
    odd = _unknown(df, column, known)
    r.add(f"{column} labels", not odd, f"unknown {odd}")
    if all_wanted:
        found = {x[0] for x in df.where(F.col(column).isin(list(known))).select(column).distinct().collect()}
        r.add(f"{column} all present", set(known) <= found, f"absent {sorted(set(known) - found)}", WARN)


def validate_tier1(df: DataFrame, least: int = 500, least_control: int = 1000) -> Report:
    """All checks of a tier-1 table from one pass over it, grouped by condition."""
    r = Report()
    if not _columns(r, df, TIER1):
        return r
    ranges = {**{c: (0, 100) for c in TRUST_NAMES}, **vocab.OUTCOMES}
    whole = F.col("donation_ams").cast("double")
    # What is checked is made once: its checks are several queries.
    df = written(df.select("profile_id", "condition", *vocab.MODERATORS, "newsletter_signup", "donation_ams",
        *[R.number_in(df, c).alias(c) for c in ranges if c not in ("donation_ams", "newsletter_signup")]), "rows")
    number = lambda c: R.number_in(df, c)
    off = F.abs(R.composite([TRUST_NAMES[i : i + 3] for i in range(0, 12, 3)], number) - number("trust_multidimensional"))
    asked = {"n": F.count(F.lit(1)), "fractions": F.count_if(whole != F.rint(whole)), "not binary": F.count_if(~F.col("newsletter_signup").isin(0, 1)), "off": F.max(off)}
    for m, levels in vocab.MODERATORS.items():
        asked |= {f"{m}: missing": F.count_if(F.col(m).isNull()), f"{m}: unknown": F.count_if(~F.col(m).isin(levels))}
    for c, (low, high) in ranges.items():
        asked |= {f"{c}: missing": F.count_if(number(c).isNull()), f"{c}: outside": F.count_if(~number(c).between(low, high))}
    # A row per known condition, one for rows without any, one for all others together.
    known = F.col("condition").isin(vocab.CONDITIONS)
    named = df.withColumns({"_condition": F.when(known, F.col("condition")), "_other": F.col("condition").isNotNull() & ~known})
    rows = [x.asDict() for x in named.groupBy("_condition", "_other").agg(*[c.alias(k) for k, c in asked.items()]).collect()]
    total = lambda k: sum(x[k] for x in rows)
    found = {x["_condition"] for x in rows if x["_condition"]}
    odd = _unknown(df, "condition", vocab.CONDITIONS) if any(x["_other"] for x in rows) else []
    r.add("condition labels", not odd, f"unknown {odd}")
    r.add("condition all present", set(vocab.CONDITIONS) <= found, f"absent {sorted(set(vocab.CONDITIONS) - found)}", WARN)
    for m, levels in vocab.MODERATORS.items():
        odd = _unknown(df, m, levels) if total(f"{m}: unknown") else []
        r.add(f"{m} labels", not odd, f"unknown {odd}")
        missing = total(f"{m}: missing")
        r.add(f"{m} known", missing < max(1, total("n")), "all missing")
        r.add(f"{m} mostly known", missing <= 0.1 * total("n"), f"{missing} of {total('n')} missing", WARN)
    small = [f"{x['_condition']}: {x['n']}" for x in rows if not x["_other"] and x["n"] < (least_control if x["_condition"] == vocab.CONTROL else least)]
    r.add("sample sizes", not small, ", ".join(sorted(small)), WARN)
    d = duplicates(df, ["profile_id"]).first()
    r.add("profile_id unique", d.n_duplicates == 0, f"{d.n_duplicates} repeated", WARN)
    furthest = max((x["off"] for x in rows if x["off"] is not None), default=None)
    r.add("composite agrees with items", furthest is None or furthest <= 0.51, f"off by {furthest}", WARN)
    for c in ranges:
        r.add(f"{c} range", total(f"{c}: outside") == 0, f"{total(f'{c}: outside')} values outside")
        r.add(f"{c} present", total(f"{c}: missing") == 0, f"{total(f'{c}: missing')} missing", WARN)
    r.add("donation whole dollars", total("fractions") == 0, f"{total('fractions')} fractions")
    r.add("newsletter binary", total("not binary") == 0, f"{total('not binary')} other values")
    return r


def _cells(r: Report, df: DataFrame, dims: Sequence[str], value: str, expected: int, ranged: bool) -> None:
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*dims)).alias("d"), F.count_if(R.number(value).isNull()).alias("missing")).first()
    r.add("no repeated cells", g.n == g.d, f"{g.n - g.d} repeated")
    r.add("all cells", g.d == expected, f"{g.d} of {expected}")
    r.add("no missing values", g.missing == 0, f"{g.missing} missing")
    if ranged:
        low, high = (R.code_map("outcome", {o: float(x[i]) for o, x in vocab.OUTCOMES.items()}) for i in (0, 1))
        bad = df.agg(F.count_if(~R.number(value).between(low, high))).first()[0]
        r.add("ranges", bad == 0, f"{bad} outside")


def validate_tier2_main(df: DataFrame) -> Report:
    r = Report()
    if _columns(r, df, ["condition", "outcome", "mean"]):
        df = written(df.select("condition", "outcome", "mean"), "cells")  # its checks are several queries
        _labels(r, df, "condition", vocab.CONDITIONS)
        _labels(r, df, "outcome", list(vocab.OUTCOMES))
        _cells(r, df, ["condition", "outcome"], "mean", len(vocab.CONDITIONS) * len(vocab.OUTCOMES), True)
    return r


def validate_tier2_moderator(df: DataFrame) -> Report:
    r = Report()
    if _columns(r, df, ["condition", "moderator", "moderator_level", "outcome", "mean"]):
        df = written(df.select("condition", "moderator", "moderator_level", "outcome", "mean"), "cells")
        _labels(r, df, "condition", vocab.CONDITIONS)
        _labels(r, df, "outcome", list(vocab.OUTCOMES))
        pairs = [(m, v) for m, vs in vocab.MODERATORS.items() for v in vs]
        found = {tuple(x) for x in df.select("moderator", "moderator_level").distinct().collect()}
        r.add("moderator levels", found <= set(pairs), f"unknown {sorted(map(str, found - set(pairs)))}", WARN)
        _cells(r, df, ["condition", "moderator", "moderator_level", "outcome"], "mean", len(vocab.CONDITIONS) * len(pairs) * len(vocab.OUTCOMES), True)
    return r


def validate_tier3(df: DataFrame) -> Report:
    r = Report()
    if _columns(r, df, ["condition", "outcome", "ate"]):
        df = written(df.select("condition", "outcome", "ate"), "cells")
        r.add("no control rows", df.where(F.col("condition") == vocab.CONTROL).isEmpty(), "control is its own base")
        _labels(r, df, "condition", vocab.INTERVENTIONS)
        _labels(r, df, "outcome", list(vocab.OUTCOMES))
        _cells(r, df, ["condition", "outcome"], "ate", len(vocab.INTERVENTIONS) * len(vocab.OUTCOMES), False)
    return r


def sanity(tiers: dict[str, DataFrame]) -> Report:
    r = Report()
    for name, check in (("tier2_main", validate_tier2_main), ("tier2_moderator", validate_tier2_moderator), ("tier3", validate_tier3)):
        r.rows += [(f"{name}: {c}", s, d) for c, s, d in check(tiers[name]).rows]
    return r


def _text(x) -> bool:
    return isinstance(x, str) and x.strip() != ""


def _whole(x) -> int | None:
    """A number that is given as such or as text."""
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def validate_metadata(meta: dict, files: Sequence[str] = (), hashes: dict[str, str] | None = None) -> Report:
    """What a deposit tells of itself: who, tier and entry, models and approach, disclosure class and escrow, blinding, full
    coverage, and that the prediction files named are there with their hashes.

    A deposit whose files are all examples still is *staged*: that is one warning, and nothing of its files is checked."""
    r = Report()
    for f in ("team_id", "team_name", "contact"):
        r.add(f"{f} given", _text(meta.get(f)), "missing or empty")
    tier = _whole(meta.get("tier"))
    r.add("tier", tier in (1, 2, 3), f"{meta.get('tier')}")
    r.add("entry", re.fullmatch(r"primary|secondary-\d+", str(meta.get("entry"))) is not None, f"{meta.get('entry')}")
    models = meta.get("models")
    r.add("models listed", bool([models] if _text(models) else models), "none")
    r.add("approach_family given", _text(meta.get("approach_family")), "missing or empty")
    kind, escrow = meta.get("disclosure_class"), meta.get("escrow_doi")
    r.add("disclosure_class", kind in ("A", "B", "C"), f"{kind}")
    if kind == "A":
        r.add("no escrow for class A", escrow is None, f"{escrow}", WARN)
    elif kind in ("B", "C"):
        r.add(f"escrow for class {kind}", escrow is not None, "missing", WARN)
    r.add("blinding attested", meta.get("blinding_attestation") is True, "must be true")
    cover = meta.get("coverage") or {}
    given = (cover.get("interventions"), cover.get("outcomes"))
    r.add("coverage given", None not in given, f"{cover}")
    r.add("coverage full", tuple(map(_whole, given)) == (len(vocab.INTERVENTIONS), len(vocab.OUTCOMES)), f"{cover}: every intervention and outcome must be predicted")
    entries = meta.get("prediction_files") or []
    if not r.add("prediction files listed", bool(entries), "none"):
        return r
    team = meta.get("team_id") or ""
    if team and team != "example" and all(e["file"].rpartition("/")[2].startswith("example_") for e in entries):
        r.add(f"staged for {team}", False, "the files named are still the examples", WARN)
        return r
    wanted = 2 if tier == 2 else 1
    r.add(f"file count for tier {tier}", len(entries) == wanted, f"{len(entries)} of {wanted}", WARN)
    for e in entries:
        name = e["file"]
        r.add(f"{name} name", file_name_ok(name.rpartition("/")[2], team, tier), "not TEAM_Tn_ENTRY_vN.csv")
        if r.add(f"{name} present", name in files, "missing"):
            actual = (hashes or {}).get(name) or ""
            r.add(f"{name} sha256", actual.lower() == (e.get("sha256") or "").lower(), "differs")
    return r


_CHECKS = "array<struct<check:string,status:string,detail:string>>"


def _spread(df: DataFrame) -> DataFrame:
    """df over all tasks that the cluster has slots for: a table of few bytes is read by one or two, however long its rows take in Python."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def metadata_reports(deposits: DataFrame) -> DataFrame:
    """validate_metadata() of many deposits: ``id, metadata`` (JSON) and ``files`` (a map of the files that are there to their hashes) ->
    ``id, check, status, detail``.  Metadata that are no JSON object fail that one check."""

    def rows(meta: str | None, files: str | None) -> list[tuple[str, str, str]]:
        try:
            told = json.loads(meta or "")
        except ValueError:
            told = None
        if not isinstance(told, dict):
            return [("metadata are a JSON object", FAIL, "not one")]
        there = json.loads(files or "{}")
        return validate_metadata(told, list(there), there).rows

    @F.arrow_udf(_CHECKS)
    def checks(meta: pa.Array, files: pa.Array) -> pa.Array:
        told, ends = [], [0]
        for m, f in zip(meta.to_pylist(), files.to_pylist(), strict=True):
            told += rows(m, f)
            ends.append(len(told))
        fields = [pa.array([x[i] for x in told], pa.string()) for i in range(3)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["check", "status", "detail"]))

    some = _spread(deposits.select("id", "metadata", F.to_json("files").alias("files")))
    return some.select("id", F.explode(checks("metadata", "files")).alias("c")).select("id", "c.*")


def blank_answer_counts(forms: DataFrame, column: str = "form") -> DataFrame:
    """forms with ``blank``: how many items of each registration form have no answer."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(blank_answers(t or ""))).astype("int32")

    return _spread(forms).withColumn("blank", count(F.col(column)))


def staged(r: Report) -> bool:
    return any(c.startswith("staged for ") for c, _, _ in r.rows)


def file_name_ok(name: str, team: str, tier: int) -> bool:
    """TEAM_Tn_ENTRY_vN.csv, for condition means with the kind of cells; entries are primary or secondary-k."""
    cells = r"_cells_(main|moderator)" if tier == 2 else ""
    return re.fullmatch(rf"{re.escape(team)}_T{tier}_(primary|secondary-\d+)_v\d+{cells}\.csv", name) is not None


def validate_bundle(spark: SparkSession, folder: str, metadata: str = "metadata.json") -> Report:
    """A deposit: its metadata, and the contents by tier of each prediction file that they name."""
    folder = folder.rstrip("/")
    r = Report()
    if not r.add(f"{metadata} present", readers.exists(spark, f"{folder}/{metadata}"), "missing"):
        return r
    try:
        meta = readers.read_json_document(spark, f"{folder}/{metadata}")
    except ValueError as e:
        r.add(f"{metadata} is JSON", False, str(e)[:200])
        return r
    tier = _whole(meta.get("tier"))
    hashes = {e["file"]: h for e in meta.get("prediction_files") or [] if (h := sinks.fingerprint(spark, f"{folder}/{e['file']}"))}
    told = validate_metadata(meta, list(hashes), hashes)
    r.rows += told.rows
    if staged(told):
        return r
    for name in hashes:
        table = readers.read_csv(spark, f"{folder}/{name}").replace("", None)
        check = {1: validate_tier1, 3: validate_tier3}.get(tier) or (validate_tier2_moderator if "_cells_moderator" in name else validate_tier2_main)
        r.rows += [(f"{name}: {c}", s, d) for c, s, d in check(table).rows]
    return r


def blank_answers(registration: str) -> list[str]:
    """Items of a registration form with no answer: a label line that ends in a colon, and then a blank line, another item or
    a heading (or nothing).  An answer on the line after its label is one."""
    lines = [x.rstrip() for x in registration.splitlines()]
    out = []
    for label, following in zip(lines, [*lines[1:], ""], strict=False):
        after = following.strip()
        if re.fullmatch(r"- \*\*.*\*\* [\u2014-] .*:", label) and (not after or after.startswith(("- **", "#"))):
            out.append(label)
    return out


#: What an archive's legacy deposit format allows.
UPLOAD_TYPES = ["publication", "poster", "presentation", "dataset", "image", "video", "software", "lesson", "physicalobject", "other"]
ACCESS_RIGHTS = ["open", "embargoed", "restricted", "closed"]
RELATIONS = [
    "isCitedBy", "cites", "isSupplementTo", "isSupplementedBy", "isContinuedBy", "continues", "isDescribedBy", "describes", "hasMetadata", "isMetadataFor",
        "isNewVersionOf", "isPreviousVersionOf", "isPartOf", "hasPart", "isReferencedBy",
    "references", "isDocumentedBy", "documents", "isCompiledBy", "compiles", "isVariantFormOf", "isOriginalFormOf", "isIdenticalTo", "isAlternateIdentifier",
        "isReviewedBy", "reviews", "isDerivedFrom", "isSourceOf", "requires",
    "isRequiredBy", "isObsoletedBy", "obsoletes",
]


def validate_citation(record: dict) -> Report:
    """A deposit's citation record, as far as it can be told without asking the archive."""
    r = Report()
    creators = record.get("creators") or []
    names = [x.get("name") or "" for x in creators]
    warn = lambda check, ok, detail: r.add(check, ok, detail, WARN)
    warn("title, description and creator", _text(record.get("title")) and _text(record.get("description")) and bool(names) and all(names), "fill in all three")
    warn("upload_type", record.get("upload_type") in UPLOAD_TYPES, f"{record.get('upload_type')}")
    warn("access_right", record.get("access_right") is None or record["access_right"] in ACCESS_RIGHTS, f"{record.get('access_right')}")
    warn("licence", _text(record.get("license")), "missing")
    words = record.get("keywords")
    warn("keywords", words is None or (isinstance(words, list) and all(map(_text, words))), "must be a list of texts")
    warn("creators filled in", not any(sinks.NO_NAME in n for n in names), f"still {sinks.NO_NAME}")
    bad = [x["orcid"] for x in creators if x.get("orcid") and sinks.orcid_of(x["orcid"]) is None]
    warn("ORCIDs", not bad, f"{bad}")
    links = record.get("related_identifiers")
    warn("related identifiers", links is None or all(_text(x.get("identifier")) and x.get("relation") in RELATIONS for x in links), "one lacks its identifier, or its relation is unknown")
    return r


def validate_files(there: Sequence[str], wanted: Sequence[str], registration: str = "") -> Report:
    """Files that must be there, and registration items left blank."""
    r = Report()
    for w in wanted:
        r.add(f"{w} present", w in there, "missing")
    blank = blank_answers(registration)
    r.add("registration filled in", not blank, f"{len(blank)} blank: {blank[:3]}", WARN)
    return r


def validate_repository(spark: SparkSession, root: str, citation: str = ".zenodo.json") -> Report:
    """A whole deposit's folder: the files it must have, the registration form, the citation record, examples left over, and the bundle."""
    root = root.rstrip("/")
    has = lambda p: readers.exists(spark, f"{root}/{p}")
    text = lambda p: readers.read_text(spark, f"{root}/{p}")
    form = text("registration.md") if has("registration.md") else ""
    needed = ["metadata.json", "registration.md", "codebook.csv", "survey"]
    r = validate_files([p for p in needed if has(p)], needed, form)
    r.add("survey/survey.qsf present", has("survey/survey.qsf"), "not there yet", WARN)
    r.add("predictions hold a CSV", has("predictions/*.csv"), "none")
    meta = {}
    if has("metadata.json"):
        try:
            meta = readers.read_json_document(spark, f"{root}/metadata.json")
        except ValueError:
            meta = {}
    example = not meta or meta.get("team_id") == "example"
    if meta:
        r.add("team is not the example", not example, "team_id is still example", WARN)
        code = meta.get("code_repository") or ""
        r.add("code repository given", _text(code) and "your-team/your-repo" not in code, "link the code", WARN)
    if r.add("citation record present", has(citation), "missing", WARN):
        try:
            record = json.loads(text(citation))
        except ValueError as e:
            r.add("citation record is JSON", False, str(e)[:200])
        else:
            r.rows += [(f"citation: {c}", s, d) for c, s, d in validate_citation(record).rows]
    if not example:
        r.add("no example predictions left", not has("predictions/example_*.csv"), "delete them", WARN)
        r.add("no example raw export left", not has("raw_data_deposit/example_raw_export.csv"), "delete it", WARN)
    r.rows += validate_bundle(spark, root).rows
    return r
