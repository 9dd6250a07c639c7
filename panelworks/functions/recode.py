"""Codes and free answers to levels, numbers and composites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import vocab
from .text import blank, c, once, strip

_M = vocab.MODERATORS


def number(x) -> Column:
    """A double, or null where the text is none."""
    return F.nanvl(c(x).cast("string").try_cast("double"), F.lit(None).cast("double"))


def number_in(df, column: str) -> Column:
    """The same of a table's column; what is a number already isn't written as text and read again."""
    kind = df.schema[column].dataType
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")) if isinstance(kind, NumericType) else number(column)


def code_map(x, mapping: dict, other=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c(x) == k, F.lit(v)) if out is None else out.when(c(x) == k, F.lit(v))
    return out.otherwise(F.lit(other))


def gender(sex) -> Column:
    return code_map(number(sex), {1: "Male", 2: "Female"}, "Other")


def age_band(age) -> Column:
    """Right-closed bands; null under 18."""
    (e1, e2, e3), names = vocab.AGE_EDGES, _M["age_band"]
    return once(number(age), lambda a: F.when(a < 18, F.lit(None)).when(a <= e1, names[0]).when(a <= e2, names[1]).when(a <= e3, names[2]).when(a.isNotNull(), names[3]))


def race(hispanic, code) -> Column:
    """Hispanic origin comes before race."""
    h = number(hispanic)
    return F.when(h != 1, "Hispanic / Latino").when(h == 1, code_map(number(code), {1: "White / Caucasian", 2: "Black / African American", 6: "Asian / Asian American"}, "Other"))


def education(code) -> Column:
    s, names = number(code), _M["education"]
    return F.when(s <= 15, names[0]).when(s.isin(16, 17), names[1]).when(s.isin(18, 19, 20), names[2]).when(s == 21, names[3]).when(s.isin(22, 23), names[4]).when(s == 24, names[5])


def income(amount) -> Column:
    """Half-open bands; null below zero."""
    p, names = number(amount), _M["income"]
    return F.when(p < 0, F.lit(None)).when(p < 30_000, names[0]).when(p < 56_000, names[1]).when(p < 100_000, names[2]).when(p < 168_000, names[3]).when(p.isNotNull(), names[4])


def party(code) -> Column:
    return code_map(number(code), {1: "Democrat", 2: "Republican", 3: "Independent", 4: "Other", 5: "Other"})


def recode_person(df):
    """Census person records with all levels."""
    return df.withColumns({"gender": gender("SEX"), "age_band": age_band("AGEP"), "race": race("HISP", "RAC1P"), "education": education("SCHL"), "income": income("PINCP")})


def decode(x, levels: list[str], aliases: dict[str, str] | None = None) -> Column:
    """A level from its 1-based code, its label or an alias; null for blank; an error for anything else."""

    def level_of(t: Column) -> Column:
        out = F.when(t == "", F.lit(None).cast("string"))
        for i, level in enumerate(levels, 1):
            out = out.when((t == str(i)) | (F.lower(t) == level.lower()), level)
        for alias, level in (aliases or {}).items():
            out = out.when(F.lower(t) == alias.lower(), level)
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown level: "), t)).cast("string"))

    return once(strip(blank(x)), level_of)


def birth_year(x, survey_year: int = vocab.SURVEY_YEAR) -> Column:
    """The one year that a text names; of several the one after "born in", else the last; without any, an age from 18 to 100."""

    def year_of(r: Column) -> Column:
        t, years = r["t"], r["years"]
        born = F.nullif(F.regexp_extract(t, r"(?i)born in\s+(19\d\d|20\d\d)", 1), F.lit(""))
        from_age = once(F.regexp_extract(t, r"\d+", 0).try_cast("int"), lambda age: F.when(age.between(18, 100), survey_year - age))
        return F.when(F.size(years) == 1, F.get(years, F.lit(0)).try_cast("int")).when(F.size(years) > 1,
            F.coalesce(born, F.try_element_at(years, F.lit(-1))).try_cast("int")).otherwise(from_age)

    years = lambda t: F.regexp_extract_all(t, F.lit(r"(?<!\d)(19\d\d|20\d\d)(?!\d)"), F.lit(1))
    return once(blank(x), lambda t: once(F.struct(t.alias("t"), years(t).alias("years")), year_of))


def binary(x) -> Column:
    """1 for yes, 0 for no, of numbers (1, 2, also 0) and words."""
    both = F.struct(F.lower(strip(blank(x))).alias("t"), number(x).alias("d"))
    return once(both, lambda r: F.when((r["d"] == 1) | r["t"].isin("yes", "true"), 1).when(r["d"].isin(0, 2) | r["t"].isin("no", "false"), 0))


def reverse(x, top: int = 100) -> Column:
    return F.lit(top) - c(x)


def half_even(x, digits: int = 0) -> Column:
    return F.bround(c(x), digits)


def mean_of(*xs) -> Column:
    """The mean of the values that are there; null if none is."""
    return _mean([number(x) for x in xs])


def _mean(values: list[Column]) -> Column:
    """The mean of doubles that are there.  Built-in sums, which are compiled with all else; a lambda over an array would not be."""
    if len(values) == 1:
        return values[0]
    total, n = (sum(xs[1:], xs[0]) for xs in ([F.coalesce(v, F.lit(0.0)) for v in values], [v.isNotNull().cast("int") for v in values]))
    return F.when(n > 0, total / n)


def composite(groups: list[list], value=number) -> Column:
    """The mean of the means of groups; value gives the number of each of their columns."""
    return _mean([_mean([value(x) for x in g]) for g in groups])


def condition(x) -> Column:
    """The condition of a code name or title, white space squeezed; an error for anything else."""

    def title_of(t: Column) -> Column:
        out = F.when(t == "", F.lit(None).cast("string"))
        for name, title in vocab.CODENAMES.items():
            out = out.when(t == name, title)
        return out.when(t.isin(vocab.CONDITIONS), t).otherwise(F.raise_error(F.concat(F.lit("unknown condition: "), t)).cast("string"))

    return once(F.regexp_replace(strip(blank(x)), r"\s+", " "), title_of)


def state(x) -> Column:
    """A state's name from its code, alias or name in any case; null where unknown."""
    t = strip(blank(x))
    low = F.replace(F.lower(t), F.lit("r/"), F.lit(""))
    names = {**{n.lower(): n for ns in vocab.STATE_CASES.values() for n in ns}, **vocab.STATE_ALIASES}
    table = F.create_map(*[F.lit(y) for kv in names.items() for y in kv])
    codes = F.create_map(*[F.lit(y) for kv in vocab.STATE_CODES.items() for y in kv])
    return F.coalesce(F.try_element_at(codes, F.upper(t)), F.try_element_at(table, low))


def state_case(x) -> Column:
    s = state(x)
    out = F.lit(4)
    for n, names in vocab.STATE_CASES.items():
        out = F.when(s.isin(names), n).otherwise(out)
    return out


def resolved_birth_year(year, other, age, band) -> Column:
    """The year given, else from the age; the band's stand-in where there is none or it misses the band."""
    whole = lambda x: number(x).cast("int")
    y = F.coalesce(whole(year), whole(other), vocab.SURVEY_YEAR - whole(age))
    stand_in = vocab.SURVEY_YEAR - code_map(band, vocab.BAND_AGE)
    years = vocab.SURVEY_YEAR - y
    own = F.when(years <= 29, "18-29").when(years <= 44, "30-44").when(years <= 59, "45-59").otherwise("60+")
    return F.when(y.isNotNull() & (own == c(band)), y).otherwise(stand_in)


def seed(*parts) -> Column:
    """A 32-bit number from the SHA-256 of the parts joined by ``||``."""
    text = F.concat_ws("||", *[blank(p) for p in parts])
    return F.conv(F.right(F.sha2(text, 256), F.lit(8)), 16, 10).cast("bigint")


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(blank(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def orcid_ok(x) -> Column:
    """Four groups of four and a MOD 11-2 check digit."""

    def ok(t: Column) -> Column:
        digit = lambda i: F.substr(t, F.lit(i + (i - 1) // 4), F.lit(1)).try_cast("int")
        total = sum((F.coalesce(digit(i), F.lit(0)) * 2 ** (16 - i) for i in range(2, 16)), F.coalesce(digit(1), F.lit(0)) * 2**15)
        check = (12 - total % 11) % 11
        return F.when(F.rlike(t, F.lit(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$")), F.right(t, F.lit(1)) == F.element_at(F.array(*[F.lit(d) for d in "0123456789X"]), check + 1)).otherwise(False)

    # As the element of an array the text is made once, whatever it comes from.
    return F.get(F.transform(F.array(blank(x)), ok), F.lit(0))
