"""An index of literals for many patterns: which of them can match a text at all.

Out of a pattern come *needles*, literals of which any match contains at least one: the words of its alternatives, or
parts of them.  A text is cut into words once and met with all needles at once; a pattern runs only where one of its
own is there.  The result is that of the patterns by themselves, whatever they are: a pattern without needles always runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as K  # what patterns are made of
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of these in a folded text; whatever a word boundary is, it lies between one of these and another character.
_INNER = set("abcdefghijklmnopqrstuvwxyz0123456789_")
#: Words that most English texts have, so they tell little.
_COMMON = set("a an and are as at be but by for from has have i in is it not of on or that the this to was what when with you".split())


@dataclass(frozen=True)
class Needle:
    text: str
    #: A word by itself, not only part of a longer run.
    whole: bool
    #: The run of characters, words or not, that it stands in.
    run: str = field(default="", compare=False)

    def weight(self) -> tuple[bool, int, bool]:
        return self.text not in _COMMON, len(self.text) + self.whole, self.whole


def needles(pattern: str) -> frozenset[Needle] | None:
    """Needles of a pattern, in lower case; None if it has none."""
    return _of(_parser.parse(pattern, re.I), False, False)


def _apart(op, value) -> bool:
    """Whether a part of a pattern is a border of words: \\b, or something that no word has in it."""
    if op is K.AT:
        return value in (K.AT_BOUNDARY, K.AT_BEGINNING, K.AT_END, K.AT_BEGINNING_STRING, K.AT_END_STRING)
    if op is K.LITERAL:
        return chr(value).lower() not in _INNER and chr(value).isascii()
    if op is K.IN:
        return all(_apart(*x) or x == (K.CATEGORY, K.CATEGORY_SPACE) for x in value)
    if op is K.MAX_REPEAT:
        return value[0] > 0 and all(_apart(*x) for x in value[2])
    return False


def _around(parts, i: int) -> str:
    """The longest run of ASCII characters that holds the i-th part."""
    plain = lambda k: 0 <= k < len(parts) and parts[k][0] is K.LITERAL and chr(parts[k][1]).isascii()
    first = last = i
    while plain(first - 1):
        first -= 1
    while plain(last + 1):
        last += 1
    return "".join(chr(v).lower() for _, v in parts[first : last + 1])


def _of(parts, left: bool, right: bool) -> frozenset[Needle] | None:
    """The best needles of a sequence; left, right: whether a border of words comes before and after it."""
    parts, found, run, start = list(parts), [], "", left
    for i, (op, value) in enumerate([*parts, (None, None)]):
        if op is K.LITERAL and chr(value).lower() in _INNER:
            if not run:
                start = left if i == 0 else _apart(*parts[i - 1])
            run += chr(value).lower()
            continue
        if run:
            end = right if op is None else _apart(op, value)
            found.append(frozenset([Needle(run, start and end, _around(parts, i - 1))]))
            run = ""
        before, after = left if i == 0 else _apart(*parts[i - 1]), right if i + 1 >= len(parts) else _apart(*parts[i + 1])
        if op is K.LITERAL:
            found.append(frozenset([Needle(chr(value).lower(), False)]) if chr(value).isascii() else None)
        elif op is K.SUBPATTERN:
            found.append(_of(value[3], before, after))
        elif op is K.MAX_REPEAT and value[0] > 0:
            found.append(_of(value[2], False, False))
        elif op is K.BRANCH:
            each = [_of(b, before, after) for b in value[1]]
            found.append(None if None in each else frozenset().union(*each))
    # Of all that a match must contain, what is rarest: whole words, then the longest of parts.
    return max((f for f in found if f), key=lambda f: min(n.weight() for n in f), default=None)


def matches(folded: Column, patterns: dict[str, tuple[str, Column]]) -> Column:
    """An array of the names of those patterns that match.  patterns: name -> (pattern, what says whether it does).

    folded: the text in lower case, any letter that a pattern takes for one of a to z already that one."""
    sets = {name: needles(p) for name, (p, _) in patterns.items()}
    words = sorted({n.text for s in sets.values() if s for n in s if n.whole})
    # All words of all patterns are looked for in one pass; what is there is a short list.
    there = F.array_intersect(F.split(folded, "[^a-z0-9_]+"), F.array(*map(F.lit, words)).cast("array<string>"))

    def each(there: Column) -> Column:
        out = []
        for name, (_, run) in patterns.items():
            if sets[name]:
                wide = {n.text: n.run for n in sets[name] if n.whole and n.text in _COMMON and n.run != n.text}
                own = sorted(n.text for n in sets[name] if n.whole and n.text not in wide)
                parts = sorted(n.text for n in sets[name] if not n.whole)
                may = F.arrays_overlap(there, F.array(*map(F.lit, own))) if own else F.lit(False)
                for text, around in sorted(wide.items()):
                    may = may | (F.array_contains(there, text) & F.contains(folded, F.lit(around)))
                for part in parts:
                    may = may | F.contains(folded, F.lit(part))
                run = may & run
            out.append(F.when(run, F.lit(name)))
        return F.array_compact(F.array(*out))

    return F.get(F.transform(F.array(there), each), F.lit(0))
