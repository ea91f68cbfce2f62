"""Tables of code points: case folds, diacritics, classes. Built from rules on first use; workers build their own."""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict

import numpy as np

from .options import CharClass, Preset, Unicode

SIZE = 0x110000

# Where diacritics are stripped, and exceptions from the rule below.
STRIP_RANGES = ((0xC0, 0x2AF), (0x363, 0x36F), (0x1D00, 0x1D65), (0x1E00, 0x1EFF), (0x2071, 0x2071), (0x2095, 0x209C), (0x2184, 0x2184))
STRIP_CAPITALS = "İŸƁƆƉƊƎƐƓƗƜƝƟƮƲȠȺȻȽȾɃɄɅɆɈɊɌɎẤẦẨẪẬẮẰẲẴẶẾỀỂỄỆỐỒỔỖỘỚỜỞỠỢỨỪỬỮỰ"
STRIP_NOT = "ŉǖǘǚǜǟǡǭǻǿȫȭȱʄʯḉḕḗḝḯḹḻṍṏṑṓṙṝṥṧṩṷṹṻẇẓẜẝẻỹỽỿₙ"
STRIP_OTHER = {"ɑ": "a"}
# White space beyond ASCII, and in ASCII (no vertical tab).
WHITE_ASCII = " \t\n\f\r"
WHITE_OTHER = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = WHITE_ASCII + WHITE_OTHER


@functools.cache
def folds() -> dict[int, int]:
    """Simple one-to-one case folds beyond ASCII."""
    out = {}
    for c in range(0x80, SIZE):
        s = chr(c)
        f = s.casefold() if len(s.casefold()) == 1 else s.lower()
        if len(f) == 1 and f != s:
            out[c] = ord(f)
    return out


@functools.cache
def strips() -> dict[int, int]:
    """Latin letters to ASCII: the one letter that the character's name gives, upper case for capitals.

    Beyond Latin-1 capitals stay as they are, but for those listed.
    """
    out = {}
    for a, b in STRIP_RANGES:
        for c in range(a, b + 1):
            name = unicodedata.name(chr(c), "")
            words = name.partition(" WITH ")[0].split()
            letters = [w for w in words if len(w) == 1]
            if "LATIN" not in words or "LIGATURE" in name or len(letters) != 1 or chr(c) in STRIP_NOT:
                continue
            if c < 0x100 or unicodedata.category(chr(c)) not in ("Lu", "Lt") or chr(c) in STRIP_CAPITALS:
                out[c] = ord(letters[0] if "CAPITAL" in words else letters[0].lower())
    return out | {ord(a): ord(b) for a, b in STRIP_OTHER.items()}


def fold_cp(c: int, ignore_case: bool, normalize: bool, unicode: Unicode = Unicode.FULL) -> int:
    """Diacritics first, then case, once each."""
    lite = unicode == Unicode.LITE
    if normalize and not lite:
        c = strips().get(c, c)
    if ignore_case:
        if 65 <= c <= 90:
            return c + 32
        if not lite:
            return folds().get(c, c)
    return c


def is_upper(c: int, unicode: Unicode = Unicode.FULL) -> bool:
    return 65 <= c <= 90 or (unicode != Unicode.LITE and c in folds())


def has_diacritic(c: int, unicode: Unicode = Unicode.FULL) -> bool:
    return unicode != Unicode.LITE and c in strips()


@functools.cache
def fold_table(ignore_case: bool, normalize: bool, unicode: Unicode = Unicode.FULL) -> np.ndarray:
    out = np.arange(SIZE, dtype=np.uint32)
    for c in {*range(65, 91), *folds(), *strips()}:
        out[c] = fold_cp(c, ignore_case, normalize, unicode)
    return out


@functools.cache
def sources(ignore_case: bool, normalize: bool, unicode: Unicode = Unicode.FULL) -> dict[int, tuple[int, ...]]:
    """For each code point that others fold to: all that do, itself included if it folds to itself."""
    out = defaultdict(set)
    for c in {*range(65, 91), *folds(), *strips()}:
        out[fold_cp(c, ignore_case, normalize, unicode)].add(c)
    for c in list(out):
        if fold_cp(c, ignore_case, normalize, unicode) == c:
            out[c].add(c)
    return {c: tuple(sorted(s)) for c, s in out.items()}


@functools.cache
def _general_classes() -> np.ndarray:
    import regex

    out = np.full(SIZE, CharClass.NONWORD, dtype=np.int8)
    every = "".join(chr(c) for c in range(0x80, SIZE) if not 0xD800 <= c <= 0xDFFF)

    def put(pattern: str, k: CharClass, only=None):
        found = np.array([ord(c) for c in regex.findall(pattern, every)], dtype=np.int64)
        out[found] = k

    put(r"\p{Alphabetic}", CharClass.LETTER)
    for c in folds():
        out[c] = CharClass.UPPER
    put(r"\p{Lowercase}", CharClass.LOWER)
    put(r"[\p{Nd}\p{Nl}\p{No}]", CharClass.NUMBER)
    for s in WHITE_OTHER:
        out[ord(s)] = CharClass.WHITESPACE
    return out


@functools.cache
def class_table(preset: Preset) -> np.ndarray:
    """The class of every code point; it is that of the original character, whatever is folded."""
    if preset.unicode == Unicode.FULL:
        out = _general_classes().copy()
    else:
        out = np.full(SIZE, CharClass.LETTER, dtype=np.int8)
        if preset.unicode == Unicode.COMPACT:
            out[list(folds())] = CharClass.UPPER
        for s in WHITE_OTHER:
            out[ord(s)] = CharClass.WHITESPACE
    for c in range(0x80):
        s = chr(c)
        out[c] = CharClass.LOWER if s.islower() else CharClass.UPPER if s.isupper() else CharClass.NUMBER if s.isdigit() else CharClass.WHITESPACE if s in WHITE_ASCII else CharClass.DELIMITER if s in preset.delimiters else CharClass.NONWORD
    return out


@functools.cache
def bonus_table(preset: Preset, fast: bool) -> np.ndarray:
    """What a character is worth by the class before it and its own: [before, own]."""
    K = CharClass
    out = np.zeros((7, 7), dtype=np.int64)
    for p in K:
        for c in K:
            turn = (p == K.LOWER and c == K.UPPER) or (p != K.NUMBER and c == K.NUMBER)
            if fast:
                out[p, c] = 8 if p <= K.DELIMITER < c else 7 if turn else 0
            elif c > K.DELIMITER and p <= K.DELIMITER:
                out[p, c] = {K.WHITESPACE: preset.white_bonus, K.DELIMITER: preset.delimiter_bonus, K.NONWORD: 8}[p]
            else:
                out[p, c] = 5 if turn else preset.white_bonus if c == K.WHITESPACE else 8 if c == K.NONWORD else 0
    return out
