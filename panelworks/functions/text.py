"""Text functions over columns: keys, words, cues, quotations, refusals, dates and rendered lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import needles, vocab

#: White space as Unicode has it; Java's \s is ASCII only.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, then) -> Column:
    """then(x), x made once however often it is used: it is the element of an array."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def in_pieces(x: Column) -> Column:
    """x, for one column of a wide projection.  Spark compiles that into one method for all columns, which the JVM leaves uncompiled
    beyond a size; with an element of an array among them it compiles them in pieces."""
    return once(x, lambda v: v)


def blank(x) -> Column:
    """Null as the empty string."""
    return F.coalesce(c(x).cast("string"), F.lit(""))


def strip(x) -> Column:
    return F.regexp_replace(c(x), rf"^{SPACE}+|{SPACE}+$", "")


def key(x) -> Column:
    """A key in its normal form: outer white space gone, lower case."""
    return F.lower(strip(blank(x)))


def bare_id(x, kinds: str = "13") -> Column:
    """An id without its kind prefix (t1_, t3_); blank becomes null."""
    return F.nullif(F.regexp_replace(strip(blank(x)), f"^t[{kinds}]_", ""), F.lit(""))


def without_r(x) -> Column:
    """A community's name without ``r/``."""
    return F.replace(blank(x), F.lit("r/"), F.lit(""))


def word_count(x) -> Column:
    return F.size(F.filter(F.split(blank(x), f"{SPACE}+"), lambda w: w != "")).cast("bigint")


def token_estimate(x) -> Column:
    """Tokens where no tokenizer is at hand: 1.3 per word, rounded down."""
    return F.floor(word_count(x) * F.lit(1.3)).cast("bigint")


def _folded(x) -> Column:
    """A text in lower case, with the letters that patterns without regard to case take for s, k and i."""
    text, odd = blank(x), "\u017f\u212a\u0130\u0131"
    some = F.contains(text, F.lit(odd[0])) | F.contains(text, F.lit(odd[1])) | F.contains(text, F.lit(odd[2])) | F.contains(text, F.lit(odd[3]))
    return F.lower(F.when(some, F.translate(text, odd, "skii")).otherwise(text))


#: A border of words of ASCII letters, digits and underscores; and white space as RE2 has it, inside brackets.
_ASCII_BORDER, _ASCII_SPACE = "(?:(?<=[a-z0-9_])(?![a-z0-9_])|(?<![a-z0-9_])(?=[a-z0-9_]))", r"\t\n\f\r "


def cues(x, ascii_words: bool = False) -> Column:
    """Names of the cues in a text, in their fixed order.  The text is folded and cut into words once; a pattern runs only where
    a word or sign that it needs is there.

    Words are of all letters, as the patterns are meant; ascii_words: of ASCII ones alone, as SQL engines with RE2 read them, so that
    "no" is a word of "noñiedoja"."""
    lower = lambda p: p.replace("TIL", "til")
    if ascii_words:
        # Of other letters two match s and k, and are no letters at a border; lower case would make a k of one and an i of a third.
        folded, odd = F.lower(F.translate(blank(x), "\u212a\u0130", "\uffff\u0131")), {"s": "\u017f", "k": "\uffff"}
        wide = lambda p: re.sub(r"(?<!\\)[sk]", lambda m: f"[{m[0]}{odd[m[0]]}]", p)
        pattern = lambda p: "(?d)" + wide(lower(p)).replace(r"\b", _ASCII_BORDER).replace(r"\s", _ASCII_SPACE)
    else:
        folded, odd, pattern = _folded(x), {}, lambda p: "(?u)" + lower(p)

    def found(t: Column) -> Column:
        runs = {n: (p, F.rlike(t, F.lit(pattern(p)))) for n, p in vocab.CUES.items()}
        made = needles.matches(t, runs)
        for letter in odd.values():
            made = F.when(F.contains(t, F.lit(letter)), F.array_compact(F.array(*[F.when(run, F.lit(n)) for n, (_, run) in runs.items()]))).otherwise(made)
        return made

    # As the element of an array the folded text is made once for all patterns.
    return F.get(F.transform(F.array(folded), found), F.lit(0))


def quotes(reply, parent, n: int = 5) -> Column:
    """Whether a line of the reply is quoted, or n consecutive words of the parent come again in it, the outer two perhaps as parts of
    longer words."""
    words = lambda x: F.regexp_extract_all(F.lower(blank(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def runs(ws: Column, m: int) -> Column:
        # The sequence of a short text would count down, hence the condition.
        starts = F.when(F.size(ws) >= m, F.sequence(F.lit(1), F.size(ws) - (m - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, m), " "))

    def echoes(pair: Column) -> Column:
        # The inner words are whole ones, so runs of them must meet first: as sets, in proportion to the texts.
        met = F.arrays_overlap(runs(pair["mine"], n - 2), runs(pair["theirs"], n - 2))
        joined = F.array_join(pair["mine"], " ")
        return F.when(met, F.exists(runs(pair["theirs"], n), lambda s: F.contains(joined, s)))

    # As the element of an array both lists of words are made once.
    echo = F.get(F.transform(F.array(F.struct(words(reply).alias("mine"), words(parent).alias("theirs"))), echoes), F.lit(0))
    return F.rlike(blank(reply), F.lit(rf"(?m)^{SPACE}*>")) | F.coalesce(echo, F.lit(False))


def refuses(x) -> Column:
    """Whether any sign of a refusal is there."""
    text = blank(x)
    found = lambda t: F.size(needles.matches(t, {p: (p, F.rlike(text, F.lit("(?iu)" + p))) for p in vocab.REFUSALS})) > 0
    return F.get(F.transform(F.array(_folded(x)), found), F.lit(0))


def removed(x) -> Column:
    return F.lower(strip(blank(x))).isin("", "[deleted]", "[removed]")


def shorten(x, limit: int) -> Column:
    """At most limit characters, the last three of a longer text being dots."""
    t = strip(F.replace(blank(x), F.lit("\r"), F.lit(" ")))
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.left(t, F.lit(limit - 3)), rf"{SPACE}+$", ""), F.lit("..."))).otherwise(t)


def with_parent(body, parent, limit: int = 300) -> Column:
    """A reply with what it replies to before it."""
    p = strip(blank(parent))
    short = F.when(F.length(p) > limit, F.concat(F.left(p, F.lit(limit - 3)), F.lit("..."))).otherwise(p)
    own = strip(blank(body))
    # Fixed value: the words around the parent's text.
    return F.when(p == "", own).otherwise(F.concat(F.lit("(Replying to another user's comment: \""), short, F.lit("\") "), own))


def record_text(title, body) -> Column:
    t, b = strip(blank(title)), strip(blank(body))
    return F.when(t != "", F.concat(t, F.lit(": "), b)).otherwise(b)


def epoch(x) -> Column:
    """Epoch seconds, also from texts like "123.0"; null where there is no number."""
    d = c(x).cast("string").try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < 1e18), d.cast("bigint"))


def day(x) -> Column:
    """The UTC date of epoch seconds, its year in as many digits as it has; else the first ten characters; else "unknown date"."""
    s, at = strip(blank(x)), epoch(x)
    # Microseconds of a timestamp must fit 64 bits; years after 9999 are formatted with a sign.
    date = F.ltrim(F.date_format(F.timestamp_seconds(F.when(F.abs(at) < 9_000_000_000_000, at)), "yyyy-MM-dd"), F.lit("+"))
    return F.coalesce(date, F.nullif(F.left(s, F.lit(10)), F.lit("")), F.lit("unknown date"))


def mould_line(created, community, title, body) -> Column:
    """A dated record as one line of a prompt."""
    return F.concat(day(created), F.lit(" (r/"), blank(community), F.lit("): "), record_text(title, body))


def signed(x, label: str, above: str, below: str) -> Column:
    """A score with its sign and the direction that it points to; null stays null."""
    d = c(x).try_cast("double")
    return F.when(d.isNotNull(), F.concat(F.lit(f"{label}: "), F.format_string("%+.3f", d), F.when(d > 0, F.lit(f" ({above}")).otherwise(F.lit(f" ({below}")), F.lit(", based on subreddit activity)")))


def background(ideology, gender, age) -> Column:
    return F.concat_ws("\n", signed(ideology, "Community-embedding ideology signal", "leans right/conservative", "leans left/liberal"),
        signed(gender, "Community-embedding gender signal", "leans women", "leans men"), signed(age, "Community-embedding age signal", "skews older", "skews younger"))


def duration(seconds: float) -> str:
    """Seconds as a short text: 45s, 3m 05s, 2h 04m."""
    s = int(seconds)
    if s < 60:
        return f"{s}s"
    return f"{s // 60}m {s % 60:02d}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60:02d}m"


def duration_text(seconds) -> Column:
    """The same of a column."""
    s = F.floor(c(seconds).cast("double")).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = lambda n: F.floor(s / n).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600,
        F.concat(whole(60), F.lit("m "), two(s % 60), F.lit("s"))).otherwise(F.concat(whole(3600), F.lit("h "), two(F.floor(s % 3600 / 60)), F.lit("m")))
