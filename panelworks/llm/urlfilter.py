"""URL filters.

Rules are indexed by their rarest literal token.  A url is cut into tokens, the tokens fetch the
candidate rules out of a hashed index, and only the candidates' regular expressions run.  All of it
is one narrow stage of built-in functions: no shuffle, no Python, and each row is judged by itself,
so a hot host costs nothing extra.  How rare a token is gets counted over all urls, for the tokens
of rules only; that count has a row per rule token.

Defined results: a null url, or one without ``://``, has empty host and path and no rule fits it;
repeated rows are judged alike; further columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_prefix

#: A rule list is part of the plan, so it is held to this many rules unless a caller says otherwise.
MAX_RULES = 50_000
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWERED = str.maketrans(UPPER, LOWER)
_ENTRY = "struct<token:string,regex:string,kind:int,size:int,block:int,text:string>"


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host (A-Z in either case) and its subdomains where the url's path starts with the path.
    ``pattern``: ``||`` anchors at a label of the host, ``*`` stands for anything, ``^`` for a separator."""

    action: str
    text: str
    pattern: bool = False

    def regex(self) -> str:
        if not self.pattern:
            host, slash, path = self.text.partition("/")
            return rf"^(?:[^/]*\.)?{_quoted(host.translate(_LOWERED) + slash + path)}"
        body = self.text.removeprefix("||")
        parts = [{"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c) or _quoted(c) for c in body]
        return ("(?is)^(?:[^/]*\\.)?" if self.text.startswith("||") else "(?is)") + "".join(parts)

    def tokens(self) -> list[str]:
        """Literal tokens that are whole tokens of every url that the rule fits."""
        text = self.text.removeprefix("||").translate(_LOWERED)
        anchored = not self.pattern or self.text.startswith("||")
        found = []
        for m in _TOKEN.finditer(text):
            before, after = text[: m.start()][-1:], text[m.end() :][:1]
            if (anchored if not before else before != "*" or not self.pattern) and after and (after != "*" or not self.pattern):
                found.append(m[0])
        return found


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def split_url(url):
    """host (A-Z lower-cased) and path columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substr(rest, F.length(host) + 1)


def _tokens(site):
    return F.array_distinct(F.split(F.translate(site, UPPER, LOWER), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, column: str, wanted: Sequence[str]) -> dict[str, int]:
    """In how many urls each wanted token stands."""
    host, path = split_url(F.col(column))
    found = urls.select(F.explode(_tokens(F.concat(host, path))).alias("t")).where(F.col("t").isin(list(wanted)))
    return {r.t: r.n for r in found.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int], max_rules: int = MAX_RULES):
    """(the index as an array column of buckets, its number of buckets, the rules without a token)."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the index is held to {max_rules}")
    size = 1 << max(1, (2 * len(rules)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    loose = []
    for rule in rules:
        entry = {"regex": rule.regex(), "kind": int(not rule.pattern), "size": len(rule.text), "block": int(rule.action == "block"), "text": rule.text}
        tokens = rule.tokens()
        if tokens:
            token = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            buckets[zlib.crc32(token.encode()) % size].append(entry | {"token": token})
        else:
            loose.append(entry | {"token": ""})
    as_column = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    return as_column(buckets, f"array<array<{_ENTRY}>>"), size, as_column(loose, f"array<{_ENTRY}>")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], column: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """pages with ``host, path, rule, pattern, verdict`` in place of columns so named.

    The longest host/path rule that fits decides (at equal length: block); where none fits, the longest
    pattern; else ``default``.
    """
    counts = token_counts(pages, column, sorted({t for r in rules for t in r.tokens()}))
    index, size, loose = build_index(rules, counts, max_rules)
    host, path = split_url(F.col(column))
    made = pages.withColumns({"host": host, "path": path})
    site = F.concat(F.col("host"), F.col("path"))
    own = F.flatten(F.transform(_tokens(site), lambda t: F.filter(F.element_at(index, (F.crc32(t) % size + 1).cast("int")), lambda e: e["token"] == t)))
    fits = F.filter(F.concat(own, loose), lambda e: F.rlike(site, e["regex"]))
    best = F.array_max(F.transform(fits, lambda e: F.struct(*(e[k].alias(k) for k in ("kind", "size", "block", "text")))))
    name = free_prefix(made.columns)
    kind, text, block = (F.col(f"{name}.{k}") for k in ("kind", "text", "block"))
    verdict = F.when(kind.isNull(), F.lit(default)).when(block == 1, F.lit("block")).otherwise(F.lit("allow"))
    return made.withColumn(name, best).withColumns({"rule": F.when(kind == 1, text), "pattern": F.when(kind == 0, text), "verdict": verdict}).drop(name)
