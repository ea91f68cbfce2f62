"""Scores of contiguous matches as native expressions: where the window starts, and what its characters are worth.

The classes of a window are digits: ASCII by one ``translate``, the rest by one pattern a class, made from the kernel's own table.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WHITE, bonus_table, class_table
from .kernel import BOUNDARY, CONSECUTIVE, MATCH, PREFIX_MOST, TOP
from .options import CharClass, Mode, Preset
from .predicates import alternatives, is_white, regex_of
from .query import Atom


def is_literal(atom: Atom) -> bool:
    """One character is the same to every mode that has no anchor."""
    return atom.mode != Mode.FUZZY or len(atom.needle) == 1


def as_substring(atom: Atom) -> Atom:
    return Atom(atom.needle, Mode.SUBSTRING, atom.negative, atom.ignore_case, atom.normalize) if atom.mode == Mode.FUZZY else atom


@functools.cache
def class_pattern(preset: Preset, kinds: tuple[int, ...], ascii_too: bool) -> str:
    """A class of characters, as ranges, of the code points that have one of these classes."""
    inside = np.isin(class_table(preset), kinds)
    inside[:0x80] &= ascii_too
    inside[0xD800:0xE000] = False  # no characters, but Java's patterns look at half of a pair
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    own = lambda c: f"\\x{{{c:x}}}" if c < 0x10000 else chr(c)  # noqa: E731 (Java looks two places back only if it sees the character itself)
    ranges = [f"{own(a)}-{own(b - 1)}" for a, b in zip(edges[::2], edges[1::2])]
    return "[" + "".join(ranges) + "]" if ranges else "[^\\x{0}-\\x{10ffff}]"


def class_digits(text: Column, preset: Preset) -> Column:
    table = class_table(preset)
    ascii_ = F.translate(text, "".join(map(chr, range(0x80))), "".join(str(int(table[c])) for c in range(0x80)))
    full = ascii_
    for kind in CharClass:
        full = F.regexp_replace(full, class_pattern(preset, (int(kind),), False), str(int(kind)))
    return F.when(text.rlike("[^\\x{0}-\\x{7f}]"), full).otherwise(ascii_)


def window_score(text: Column, start: Column, n: int, preset: Preset) -> Column:
    """The score of the ``n`` characters from ``start`` (from 0)."""
    bonuses = F.expr(f"array({', '.join(map(str, bonus_table(preset, False).flatten()))})")
    digits = class_digits(F.substring(text, F.greatest(start, F.lit(1)), F.lit(n) + (start > 0).cast("int")), preset)

    def step(state: Column, digit: Column) -> Column:
        own = digit.cast("int")
        b = F.element_at(bonuses, state["before"] * 7 + own + 1)
        first = state["lead"] < 0
        lead = F.when(first | ((b >= BOUNDARY) & (b > state["lead"])), b).otherwise(state["lead"])
        gain = F.when(first, 2 * b).otherwise(F.greatest(b, lead, F.lit(CONSECUTIVE)))
        none = state["before"] < 0
        return F.struct(own.alias("before"), F.when(none, F.lit(-1)).otherwise(lead).alias("lead"), F.when(none, state["score"]).otherwise(state["score"] + gain).alias("score"))

    zero = F.struct(F.when(start == 0, F.lit(int(preset.initial))).otherwise(F.lit(-1)).alias("before"), F.lit(-1).alias("lead"), F.lit(MATCH * n).alias("score"))
    score = F.least(F.aggregate(F.split(digits, ""), zero, step, lambda s: s["score"]), F.lit(TOP))
    if preset.prefer_prefix:
        more = F.when(start == 0, F.lit(PREFIX_MOST)).otherwise(F.floor(F.greatest(14 - F.least(start, F.lit(14)), F.lit(0)) / 2).cast("int"))
        score = F.least(score + more, F.lit(TOP))
    return score


def window_start(text: Column, atom: Atom, preset: Preset) -> Column:
    """Where the window of a match starts; ``text`` must match."""
    n = len(atom.needle)
    if atom.mode == Mode.SUBSTRING:
        return best_start(text, atom, preset)
    if atom.mode == Mode.POSTFIX:
        return F.length(text if is_white(atom.needle[-1]) else F.rtrim(text, F.lit(WHITE))) - n
    return F.lit(0) if is_white(atom.needle[0]) else F.length(text) - F.length(F.ltrim(text, F.lit(WHITE)))


def best_start(text: Column, atom: Atom, preset: Preset) -> Column:
    """The first of the occurrences that begin with the largest bonus, white space's worth at most.

    A pattern for each bonus finds its first occurrence, the largest first; an occurrence may lie over another.
    """
    literal, table, own = regex_of(atom, preset.unicode), class_table(preset), {}
    for c in alternatives(atom.needle[0], atom, preset.unicode):
        own.setdefault(int(table[c]), []).append(c)
    worth = bonus_table(preset, False)
    levels: dict[int, dict[int, list[int]]] = {}
    for kind in own:
        for before in CharClass:
            levels.setdefault(min(int(worth[before, kind]), preset.white_bonus), {}).setdefault(kind, []).append(int(before))
    starts = []
    for level in sorted(levels, reverse=True)[:-1]:
        ways = []
        for kind, before in levels[level].items():
            places = [f"(?<={class_pattern(preset, tuple(before), True)})"] + ["\\A"] * (preset.initial in before)
            first = "[" + "".join(f"\\x{{{c:x}}}" for c in own[kind]) + "]"
            ways.append(f"(?={first})" + (f"(?:{'|'.join(places)})" if len(before) < len(CharClass) else ""))
        starts.append(first_place(text, f"(?={literal})(?:{'|'.join(ways)})"))
    return F.coalesce(*starts, first_place(text, literal))


def first_place(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, f"(?s)\\A.*?(?={pattern})", 0)))


def literal_score(text: Column, atom: Atom, preset: Preset) -> Column:
    """The score of a text that matches; the start is worked out once."""
    atom = as_substring(atom)
    return F.get(F.transform(F.array(window_start(text, atom, preset)), lambda s: window_score(text, s, len(atom.needle), preset)), F.lit(0))


def literal_scores(text: Column, atoms: tuple[Atom, ...], preset: Preset) -> Column:
    """The sum over the positive atoms, all of which must be literal and match."""
    times = Counter(as_substring(a) for a in atoms if not a.negative)  # a word said twice is scored once
    return sum((literal_score(text, a, preset) * n for a, n in times.items()), F.lit(0)).cast("int")
