import pytest

from rankmatch.functions.options import Case, Mode, Norm, Scoring, SearchOptions, Unicode
from rankmatch.functions.query import parse


def shape(query, mode=Mode.FUZZY, case=Case.SMART, norm=Norm.SMART):
    return [("!" * a.negative + a.mode.value, a.needle) for a in parse(query, mode, case, norm)]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("fo  ba", [("fuzzy", "fo"), ("fuzzy", "ba")]),
        ("'gem", [("substring", "gem")]),
        ("^sup", [("prefix", "sup")]),
        ("dart$", [("postfix", "dart")]),
        ("^abc$", [("exact", "abc")]),
        ("'abc$", [("exact", "abc")]),
        ("!drag", [("!substring", "drag")]),
        ("!^drag", [("!prefix", "drag")]),
        ("\\!drag", [("fuzzy", "!drag")]),
        ("\\^sup", [("fuzzy", "^sup")]),
        ("dart\\$", [("fuzzy", "dart$")]),
        ("a\\ b c", [("fuzzy", "a b"), ("fuzzy", "c")]),
        ("a\tb", [("fuzzy", "a\tb")]),
        ("a\\b", [("fuzzy", "a\\b")]),
        ("! ^ $ '", []),
        ("   ", []),
        ("", []),
    ],
)
def test_words_become_atoms(query, expected):
    assert shape(query) == expected


def test_other_modes_take_the_query_as_it_is():
    assert shape("Super  !x", Mode.EXACT) == [("exact", "Super  !x")]
    assert shape("a\\ b", Mode.PREFIX) == [("prefix", "a b")]


def test_at_most_64_atoms_that_are_not_empty():
    assert len(parse("! " * 5 + "a " * 80)) == 64


def test_case_and_diacritics_are_decided_per_word():
    small, large = parse("rust Rust")
    assert small.ignore_case and not large.ignore_case
    assert parse("Rust", case=Case.IGNORE)[0].needle == "rust"
    assert not parse("rust", case=Case.RESPECT)[0].ignore_case
    plain, accented = parse("cafe café")
    assert plain.normalize and not accented.normalize
    assert not parse("cafe", norm=Norm.NEVER)[0].normalize
    assert parse("İ", unicode=Unicode.LITE)[0].ignore_case


def test_options_are_checked_and_merged():
    o = SearchOptions(limit=3).merged(scoring="nucleo", limit=None)
    assert (o.scoring, o.limit) == (Scoring.NUCLEO, 3) and o == SearchOptions(limit=3, scoring=Scoring.NUCLEO)
    for wrong in ({"scoring": "best"}, {"case": "upper"}, {"limit": -1}):
        with pytest.raises(ValueError):
            SearchOptions(**wrong)
