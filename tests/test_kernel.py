import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankmatch.functions import kernel
from rankmatch.functions.chars import folds, strips
from rankmatch.functions.highlight import html_of
from rankmatch.functions.kernel import Batch, match_row, positions, score_texts
from rankmatch.functions.options import DEFAULT, PATHS, Case, Mode, Norm, Preset, Scoring, Unicode
from rankmatch.functions.query import parse

PREFER = Preset(prefer_prefix=True)


def score(query, text, scoring=Scoring.FAST, mode=Mode.FUZZY, preset=DEFAULT, case=Case.SMART, norm=Norm.SMART):
    return int(score_texts([text], parse(query, mode, case, norm, preset.unicode), scoring, preset)[0])


@pytest.mark.parametrize(
    ("query", "text", "fast", "nucleo"),
    [
        ("cfg", "cfg_helper", 72, 88),
        ("cfg", "abcfgval", 56, None),
        ("cfg", "configure", 57, 61),
        ("cfg", "my_cfg", 72, 80),
        ("cfg", "xyz_config", 57, 57),
        ("fb", "founder_must_bridge", 42, 46),
        ("fzd", "fuzzy.dart", 64, 68),
        ("lens", "code_lens", 92, 104),
        ("lens", "flensburg", 76, 76),
        ("abc", "abcdef", 72, 88),
        ("abc", "axbxcx", 58, 62),
        ("src", "src/main.rs", 72, 88),
        ("ab", "a" + "." * 29 + "b", 25, 29),
        ("ab", "a" + "." * 30 + "b", -1, 28),
        ("ab", "xa" + "x" * 13 + "b", 17, 17),
        ("ab", "xa" + "x" * 14 + "b", -1, 16),
    ],
)
def test_golden_scores(query, text, fast, nucleo):
    assert score(query, text) == fast
    if nucleo is not None:
        assert score(query, text, Scoring.NUCLEO) == nucleo
    assert score(query, text, Scoring.OFF) == 0


@pytest.mark.parametrize(
    ("query", "text", "mode", "hit"),
    [
        ("zzz", "founder_must_bridge", "fuzzy", False),
        ("abc", "ab", "fuzzy", False),
        ("rust", "RUST", "fuzzy", True),
        ("Rust", "rust", "fuzzy", False),
        ("搜索", "中文搜索引擎", "fuzzy", True),
        ("cafe", "café", "fuzzy", True),
        ("café", "cafe", "fuzzy", False),
        ("α", "Αβ", "fuzzy", True),
        ("gem", "Dragon Gem", "substring", True),
        ("gem", "g e m", "substring", False),
        ("super", "supersonic", "prefix", True),
        ("super", "a super thing", "prefix", False),
        ("dart", "fuzzy.dart", "postfix", True),
        ("gem", "gems", "exact", False),
        ("gem", "  gem  ", "exact", True),
        ("gem", "  gem  ", "prefix", True),
        (" gem", " gem", "exact", True),
        (" gem", "  gem", "exact", False),
        ("gem ", "gem ", "exact", True),
        ("gem ", "gem  ", "exact", False),
        ("gem !drag", "Dragon Gem", "fuzzy", False),
        ("gem !foo", "Dragon Gem", "fuzzy", True),
        ("fo ba", "foo/bar", "fuzzy", True),
        ("\\!drag", "!dragon", "fuzzy", True),
        ("!drag", "!dragon", "fuzzy", False),
        ("dart\\$", "nodart", "fuzzy", False),
        ("a", "Ā", "fuzzy", False),
        ("a", "ā", "fuzzy", True),
        ("", "anything", "fuzzy", True),
    ],
)
def test_matches(query, text, mode, hit):
    for scoring in Scoring:
        assert (score(query, text, scoring, Mode(mode)) >= 0) == hit


def test_tables_have_their_sizes():
    assert len(folds()) == 1428 and len(strips()) == 453
    assert folds()[ord("ſ")] == ord("s") and strips()[ord("ø")] == ord("o") and strips()[ord("ß")] == ord("s")


def test_scores_saturate_and_large_windows_are_read_greedily():
    assert score("a" * 10_000, "a" * 10_000, mode=Mode.EXACT) == 65535
    assert score("a" * 200, "a" * 600) > 0
    at = positions("a" * 600, parse("a" * 200), Scoring.FAST, DEFAULT)
    assert len(at) == 200 and at == sorted(set(at))
    assert score("ab", "a" + "x" * 60_000 + "b") >= 0  # beyond the size of the matrix no gap is lost


def test_greedy_readings_of_a_batch_are_scored_together(monkeypatch):
    """As one by one, but no text is read in Python, whatever the number of arrays."""
    draw, cases = random.Random(3), []
    monkeypatch.setattr(kernel, "MATRIX_CELLS", 12)
    for preset in (DEFAULT, PATHS, PREFER):
        for scoring in (Scoring.FAST, Scoring.NUCLEO):
            texts = ["".join(draw.choices("abAB_/ 1é", k=draw.randrange(4, 40))) for _ in range(300)]
            for query in ("ab", "aba", "b1a"):
                atoms = parse(query)
                batch, needle = Batch(texts, preset), [*map(ord, query)]
                cases.append((texts, atoms, scoring, preset, [match_row(batch.row(i, atoms[0]), needle, Mode.FUZZY, scoring)[0] for i in range(len(texts))]))
    monkeypatch.setattr(kernel, "match_row", None)
    for size in (1, 100, 1 << 21):
        monkeypatch.setattr(kernel, "BATCH_CHARS", size, raising=False)
        for *case, want in cases:
            assert score_texts(*case).tolist() == want


def test_prefixes_are_preferred():
    for scoring in (Scoring.FAST, Scoring.NUCLEO):
        assert score("abc", "abc_xyz", scoring, preset=PREFER) > score("abc", "xyz_abc", scoring, preset=PREFER)


def test_a_unicode_profile_without_tables():
    lite = Preset(unicode=Unicode.LITE)
    assert score("é", "É", preset=lite) == -1 and score("e", "É", preset=lite) == -1 and score("e", "E", preset=lite) >= 0


@settings(max_examples=150, deadline=None)
@given(st.text("abAB_/ 1é", max_size=25), st.text("abAB1é", min_size=1, max_size=4), st.sampled_from([DEFAULT, PATHS, PREFER]), st.sampled_from(list(Scoring)), st.sampled_from(list(Mode)))
def test_batches_score_like_single_texts(text, query, preset, scoring, mode):
    atoms = parse(query, mode)
    row = Batch([text], preset)
    single = [match_row(row.row(0, a), [*map(ord, a.needle)], a.mode, scoring) for a in atoms]
    expected = -1 if any(s < 0 for s, _ in single) else sum(s for s, _ in single)
    assert score_texts(["zz", text, "", "ab"], atoms, scoring, preset)[1] == expected
    for s, at in single:
        if s >= 0:
            assert at == sorted(set(at)) and all(0 <= i < len(text) for i in at)


def _matrix(row, needle, start, end):
    """The fast recurrence with all cells: the best score that ends at or before each position."""
    gap_track = None
    for k, c in enumerate(needle):
        ends = [-1] * (end - start)
        for i in range(start, end):
            if row.fold[i] != c:
                continue
            b = row.fast[i]
            if k == 0:
                ends[i - start] = 16 + 2 * b
                continue
            best = -1
            for j in range(start, i):
                h = gap_track[j - start]
                if h < 0:
                    continue
                if j == i - 1:
                    best = max(best, 16 + h + max(b, 4))
                elif h - (3 + (i - j - 2)) + 1 - 1 > -1 and h - 3 - (i - j - 2) > 0:
                    best = max(best, 16 + b + h - 3 - (i - j - 2))
            ends[i - start] = best
        gap_track = ends
    return max(gap_track)


@settings(max_examples=150, deadline=None)
@given(st.text("abB_ 1", min_size=4, max_size=22), st.text("ab1", min_size=2, max_size=3))
def test_the_fast_model_against_all_pairs_of_places(text, query):
    from rankmatch.functions.kernel import fast_cells, subsequence

    row, needle = Batch([text], DEFAULT).row(0, parse(query)[0]), [*map(ord, query)]
    window = subsequence(row, needle)
    if window and len(text) > len(query):
        expected = _matrix(row, needle, window[0], window[2])
        # a gap of n characters costs 3 for the first and 1 for each other
        assert fast_cells(row, needle, window[0], window[2]) == (expected if expected > 0 else -1)


def test_html():
    assert html_of("src/main.dart", [0, 1, 2]) == "<mark>src</mark>/main.dart"
    assert html_of("a<b&c", [1, 3]) == "a<mark>&lt;</mark>b<mark>&amp;</mark>c"
    assert np.array_equal(score_texts([], parse("a"), Scoring.FAST, DEFAULT), np.empty(0))
