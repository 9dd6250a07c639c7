"""Fill-in-middle: texts are cut into units at two places and put together anew, middle last.

A grammar of units is translated to a regular expression without width: a unit ends where a character (or
a short run of characters) of one class has one of another class as its neighbour, so each boundary is a
pair of lookbehind and lookahead over those classes.  Spark's ``split`` at such an expression keeps every
character, so the pieces are the units from left to right and joining them gives the text back.  The class
before a border leaves out first halves of surrogate pairs, so no character beyond the basic plane is cut in two.  ``split`` gives one
empty piece for an empty text, which has no unit: that case is handled apart.

Everything is a narrow stage of built-in functions: no shuffle and no Python; a row is judged by itself, so
a hot source costs nothing extra, and a very long text needs memory for itself alone.

Defined results: a null text counts as empty; an empty text has no units and stays plain; a text that
contains a sentinel stays plain, for it could not be told apart after; repeated rows are treated alike, since
the draw depends on seed and id alone; a null id draws as the empty decimal; further columns pass through,
those named like a result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any character, and any but white space.  What stands before a border is never the first half of a surrogate pair.
ANY, SPACE, WORD = r"[^\x{D800}-\x{DBFF}]", r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D\x{D800}-\x{DBFF}]"


@dataclass(frozen=True)
class Grammar:
    """Units of a text: ``pattern`` says what a unit is, matched from left to right; ``borders`` says the same as pairs
    (what stands just before a border, what stands just after it), each a run of character classes."""

    pattern: str
    borders: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """The expression without width that matches between two units and nowhere else."""
        return "|".join(f"(?<={before})(?={after})" for before, after in self.borders)


GRAMMARS = {
    "line": Grammar(r"[^\n]*\n|[^\n]+", ((r"\n", r"[\s\S]"),)),
    "paragraph": Grammar(r"(?:(?!\n\n)[\s\S])*\n\n+|[\s\S]+", ((r"\n\n", r"[^\n]"),)),
    "word": Grammar(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", ((SPACE, WORD),)),
    "token": Grammar(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", ((SPACE, WORD), (WORD, SPACE))),
    "character": Grammar(r"[\s\S]", ((ANY, ANY),)),
}


@dataclass(frozen=True)
class Sentinels:
    """What marks the parts in an output.  None may begin inside another or inside itself."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all
        if len(set(marks)) < len(marks):
            raise ValueError("sentinels must differ")
        for a in marks:
            for b in marks:
                inner = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))
                if not a or inner or (a != b and a in b):
                    raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def units(text: Column, grammar: Grammar | str = "line") -> Column:
    """A text column as the array of its units; none for an empty or null text."""
    g = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, g.boundary(), -1))


def draw(seed: int, doc_id: Column, k: int) -> Column:
    """The k-th of the numbers 0 to 2^32 - 1 that seed and id give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, grammar: Grammar | str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """docs with ``n, form, prefix_chars, middle_chars, output``.

    ``n`` counts units.  ``form`` is ``plain`` (output: the text), ``psm`` or ``spm``; of 100 texts ``rate`` are not left
    plain by the draw, and of those ``spm_rate`` in 100 are ``spm``.  The characters are null for plain ones."""
    p, s, m = map(F.lit, sentinels.all)
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = [draw(seed, F.col("doc_id"), k) for k in (1, 2, 3, 4)]
    marked = text.rlike("|".join(re.escape(x) for x in sentinels.all))
    form = F.when((text == "") | marked | (drawn[2] % 100 >= rate), "plain").when(drawn[3] % 100 < spm_rate, "spm").otherwise("psm")
    # Structs step by step, so the cut, the places and the parts are evaluated once each and clash with no column.
    cut = F.struct(text.alias("text"), units(F.col("text"), grammar).alias("units"), drawn[0].alias("a"), drawn[1].alias("b"), form.alias("form"))
    rest = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    own = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0)) + "fim"
    col = lambda k: F.col(f"{own}.{k}")
    n = F.size(col("units"))
    first, last = F.least(col("a") % (n + 1), col("b") % (n + 1)).cast("int"), F.greatest(col("a") % (n + 1), col("b") % (n + 1)).cast("int")
    part = lambda start, size: F.array_join(F.slice(col("units"), start, size), "")
    parts = F.struct(
        col("text").alias("text"), n.cast("bigint").alias("n"), col("form").alias("form"),
        part(F.lit(1), first).alias("prefix"), part(first + 1, last - first).alias("middle"), part(last + 1, n - last).alias("suffix"),
    )
    output = F.when(col("form") == "psm", F.concat(p, col("prefix"), s, col("suffix"), m, col("middle")))
    output = output.when(col("form") == "spm", F.concat(s, col("suffix"), p, col("prefix"), m, col("middle"))).otherwise(col("text"))
    chars = lambda k: F.when(col("form") != "plain", F.char_length(col(k)).cast("bigint"))
    made = docs.withColumn(own, cut).withColumn(own, parts)
    return made.select(*rest, col("n").alias("n"), col("form").alias("form"), chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text, out of an output and its form alone."""
    p, s, m = sentinels.all

    def between(start: str, end: str | None) -> Column:
        after = F.substr(output, F.instr(output, start) + len(start))
        return after if end is None else F.substr(after, F.lit(1), F.instr(after, end) - 1)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
