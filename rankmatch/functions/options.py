"""Enums, presets, options and errors of the search API."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum, IntEnum


class SearchError(Exception):
    """Base of this library's errors."""


class ClosedCorpusError(SearchError):
    """A closed corpus was used."""


class Mode(str, Enum):
    FUZZY = "fuzzy"
    SUBSTRING = "substring"
    PREFIX = "prefix"
    POSTFIX = "postfix"
    EXACT = "exact"


class Case(str, Enum):
    RESPECT = "respect"
    IGNORE = "ignore"
    SMART = "smart"


class Norm(str, Enum):
    NEVER = "never"
    SMART = "smart"


class Scoring(str, Enum):
    FAST = "fast"
    NUCLEO = "nucleo"
    OFF = "off"


class KeyKind(IntEnum):
    """Kinds of keys; own kinds count from CUSTOM on."""

    ORIGINAL = 0
    PINYIN = 1
    INITIALS = 2
    ROMAJI = 3
    CUSTOM = 100


class CharClass(IntEnum):
    """The order matters: bonuses compare classes."""

    WHITESPACE = 0
    NONWORD = 1
    DELIMITER = 2
    LOWER = 3
    UPPER = 4
    LETTER = 5
    NUMBER = 6


class Unicode(str, Enum):
    """FULL: all tables. COMPACT: classes by case folds only. LITE: COMPACT without folds and diacritics beyond ASCII."""

    FULL = "full"
    COMPACT = "compact"
    LITE = "lite"


@dataclass(frozen=True)
class Preset:
    """What a boundary is worth and which characters delimit."""

    delimiters: str = "/,:;|"
    white_bonus: int = 10
    delimiter_bonus: int = 9
    initial: CharClass = CharClass.WHITESPACE
    prefer_prefix: bool = False
    unicode: Unicode = Unicode.FULL


DEFAULT = Preset()
PATHS = Preset(delimiters="/\\", white_bonus=8, delimiter_bonus=9, initial=CharClass.DELIMITER)


@dataclass(frozen=True)
class SearchOptions:
    """``limit`` 0: all hits. ``parallel`` and ``threads`` advise: with both, more threads than the session has ask for so many partitions."""

    case: Case = Case.SMART
    norm: Norm = Norm.SMART
    scoring: Scoring = Scoring.FAST
    limit: int = 0
    highlight: bool = False
    parallel: bool = False
    threads: int = 0

    def __post_init__(self):
        for name, kind in (("case", Case), ("norm", Norm), ("scoring", Scoring)):
            object.__setattr__(self, name, kind(getattr(self, name)))
        if self.limit < 0 or self.threads < 0:
            raise ValueError("limit and threads are 0 or more")

    def merged(self, **given) -> SearchOptions:
        return replace(self, **{k: v for k, v in given.items() if v is not None})


@dataclass(frozen=True)
class SearchKey:
    """A further key of an item."""

    text: str
    kind: int = KeyKind.PINYIN
