"""The query language: words are ANDed; ! negates, ^ and $ anchor, ' asks for a substring, backslash escapes."""

from __future__ import annotations

from dataclasses import dataclass

from .chars import fold_cp, has_diacritic, is_upper
from .options import Case, Mode, Norm, Unicode

MAX_ATOMS = 64  # non-empty atoms beyond are dropped


@dataclass(frozen=True)
class Atom:
    """``needle`` is folded as its flags say, but never stripped of diacritics."""

    needle: str
    mode: Mode
    negative: bool
    ignore_case: bool
    normalize: bool


def atom(needle: str, mode: Mode, negative: bool, case: Case, norm: Norm, unicode: Unicode = Unicode.FULL) -> Atom:
    cps = [*map(ord, needle)]
    ignore = case == Case.IGNORE or case == Case.SMART and not any(is_upper(c, unicode) for c in cps)
    if case == Case.IGNORE:
        cps = [fold_cp(c, True, False, unicode) for c in cps]
    normalize = norm == Norm.SMART and not any(has_diacritic(c, unicode) for c in cps)
    return Atom("".join(map(chr, cps)), mode, negative, ignore, normalize)


def words(query: str) -> list[str]:
    """Pieces between spaces that no backslash stands before."""
    out, now = [], ""
    for i, c in enumerate(query):
        if c == " " and not (i and query[i - 1] == "\\"):
            out.append(now)
            now = ""
        else:
            now += c
    return [w for w in [*out, now] if w]


def word_atom(word: str, case: Case, norm: Norm, unicode: Unicode) -> Atom:
    negative = word.startswith("!")
    if negative:
        word = word[1:]
    elif word.startswith("\\!"):
        word = word[1:]
    mode = Mode.FUZZY
    if word[:1] in ("^", "'"):
        mode = Mode.PREFIX if word[0] == "^" else Mode.SUBSTRING
        word = word[1:]
    elif word[:2] in ("\\^", "\\'"):
        word = word[1:]
    if word.endswith("\\$"):
        word = word[:-2] + "$"
    elif word.endswith("$"):
        mode = Mode.POSTFIX if mode == Mode.FUZZY else Mode.EXACT
        word = word[:-1]
    if negative and mode == Mode.FUZZY:
        mode = Mode.SUBSTRING
    return atom(word.replace("\\ ", " "), mode, negative, case, norm, unicode)


def parse(query: str, mode: Mode = Mode.FUZZY, case: Case = Case.SMART, norm: Norm = Norm.SMART, unicode: Unicode = Unicode.FULL) -> tuple[Atom, ...]:
    """Atoms of a query. Other modes than fuzzy take the whole query as one atom, spaces kept. No atoms match everything."""
    if mode == Mode.FUZZY:
        atoms = [word_atom(w, case, norm, unicode) for w in words(query)]
    else:
        atoms = [atom(query.replace("\\ ", " "), mode, False, case, norm, unicode)]
    return tuple([a for a in atoms if a.needle][:MAX_ATOMS])
