"""Native match predicates: a query becomes regular expressions on the original text, evaluated in the JVM.

A needle character matches every character that folds to it, so each becomes a character class and no folded copy of the text is
needed. Loops are possessive: no pattern backtracks over a long text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WHITE, WHITE_ASCII, fold_cp, sources
from .options import Mode, Unicode
from .query import Atom


def _cp(c: int) -> str:
    return f"\\x{{{c:x}}}"


def alternatives(char: str, atom: Atom, unicode: Unicode = Unicode.FULL) -> list[int]:
    """The code points that fold to ``char`` under the atom's flags."""
    c = ord(char)
    own = [c] if fold_cp(c, atom.ignore_case, atom.normalize, unicode) == c else []
    return sorted({*own, *sources(atom.ignore_case, atom.normalize, unicode).get(c, ())})


def regex_of(atom: Atom, unicode: Unicode = Unicode.FULL, possessive: bool = True) -> str:
    """Finds something in a text if and only if the atom matches it, but for fast scoring's lost long gaps.

    ``possessive`` is for Java, whose classes test characters beyond Latin-1 one by one: ASCII characters that do not match
    are told apart first, by one bit set.
    """
    more = "*+" if possessive else "*"
    every = [alternatives(c, atom, unicode) for c in atom.needle]
    if not all(every):
        return "[^\\x{0}-\\x{10ffff}]"  # a character to which nothing folds
    white = "[" + "".join(_cp(ord(c)) for c in WHITE) + "]"
    literal = "".join(_one(cps, possessive) for cps in every)
    lead = "" if is_white(atom.needle[0]) else white + more
    tail = "" if is_white(atom.needle[-1]) else white + "*"
    if atom.mode == Mode.FUZZY:
        return "\\A" + "".join(_others(cps, possessive) + _one(cps, possessive) for cps in every)
    return {Mode.SUBSTRING: literal, Mode.PREFIX: f"\\A{lead}{literal}", Mode.POSTFIX: f"{literal}{tail}\\z", Mode.EXACT: f"\\A{lead}{literal}{tail}\\z"}[atom.mode]


def _ascii_but(cps: list[int]) -> str:
    return "[" + "".join(_cp(c) for c in range(0x80) if c not in cps) + "]"


def _one(cps: list[int], java: bool) -> str:
    found = "[" + "".join(map(_cp, cps)) + "]"
    return f"(?!{_ascii_but(cps)}){found}" if java and cps[-1] >= 0x80 else found


def _others(cps: list[int], java: bool) -> str:
    """Any number of characters that are not among ``cps``."""
    if not java:
        return "[^" + "".join(map(_cp, cps)) + "]*"
    return f"(?:{_ascii_but(cps)}++|[^\\x{{0}}-\\x{{7f}}{''.join(_cp(c) for c in cps if c >= 0x80)}])*+"


def is_white(char: str) -> bool:
    return char in WHITE_ASCII or char in WHITE


def matches(text: Column, atoms: tuple[Atom, ...], unicode: Unicode = Unicode.FULL) -> Column:
    """All positive atoms match and no negative one does. Cheap length tests come first."""
    tests = []
    for a in sorted(dict.fromkeys(atoms), key=lambda a: a.negative):
        found = (F.length(text) >= len(a.needle)) & text.rlike(regex_of(a, unicode))
        tests.append(~found if a.negative else found)
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
