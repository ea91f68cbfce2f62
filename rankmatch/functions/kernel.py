"""Scores and positions of matches: pure position logic, without Spark.

A batch of texts is one array of code points. The two dynamic programs never fill a matrix: a cell's best gap is a running maximum
of earlier scores plus positions, so only positions that hold a needle's character are visited.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .chars import WHITE, bonus_table, class_table, fold_table
from .options import Mode, Preset, Scoring
from .query import Atom

# Fixed values of the scoring models.
MATCH, GAP_START, GAP_MORE, BOUNDARY, CONSECUTIVE = 16, 3, 1, 8, 4
PREFIX_MOST, TOP = 8, 65535
MATRIX_CELLS, NEEDLE_CELLS, WINDOW_CELLS = 102_400, 2_048, 65_535
#: Characters that are one array at once, which takes some 20 bytes for each; a longer text is one by itself.
BATCH_CHARS = 1 << 21


@dataclass(frozen=True)
class Row:
    """One text as an atom sees it: folded code points, and both bonuses of every position."""

    fold: list[int]
    full: list[int]
    fast: list[int]
    preset: Preset


def clipped(x: int) -> int:
    return max(0, min(TOP, x))


def prefix_bonus(start: int) -> int:
    """What ``prefer_prefix`` adds for a window from ``start``: less by half a point for each character before it."""
    return PREFIX_MOST if start == 0 else max(0, 13 - min(start - 1, TOP)) // 2


def window_score(row: Row, needle: list[int], start: int, end: int) -> tuple[int, list[int]]:
    """Score and positions of the first reading of the needle in [start, end), which begins with it."""
    score = MATCH + 2 * row.full[start]
    lead, run, gap, k = row.full[start], True, False, 1
    at = [start]
    for i in range(start + 1, end):
        if k < len(needle) and row.fold[i] == needle[k]:
            b = row.full[i]
            if run:
                lead = b if b >= BOUNDARY and b > lead else lead
                gain = max(b, lead, CONSECUTIVE)
            else:
                lead = gain = b
            score, run, gap, k = min(TOP, score + MATCH + gain), True, False, k + 1
            at.append(i)
        else:
            score = max(0, score - (GAP_MORE if gap else GAP_START))
            run, gap = False, True
    if row.preset.prefer_prefix:
        score = min(TOP, score + prefix_bonus(start))
    return score, at


def subsequence(row: Row, needle: list[int]) -> tuple[int, int, int] | None:
    """(start, end of the leftmost reading, end after the last place of the last character), or no match."""
    at, start = -1, -1
    for k, c in enumerate(needle):
        try:
            at = row.fold.index(c, at + 1)
        except ValueError:
            return None
        if k == 0:
            start = at
    end = len(row.fold) - row.fold[::-1].index(needle[-1])
    return start, at + 1, max(end, at + 1)


def greedy(row: Row, needle: list[int], start: int, end: int) -> tuple[int, list[int]]:
    """The leftmost reading, its start moved right as far as the reading backwards from its end goes."""
    k = len(needle) - 1
    for i in range(end - 1, start - 1, -1):
        if row.fold[i] == needle[k]:
            if k == 0:
                start = i
                break
            k -= 1
    return window_score(row, needle, start, end)


def too_large(width: int, nl: int) -> bool:
    return width * nl > MATRIX_CELLS or width > WINDOW_CELLS or nl > NEEDLE_CELLS


def literal_window(row: Row, needle: list[int], mode: Mode) -> tuple[int, int] | None:
    """The window of a contiguous match."""
    n, nl, white = len(row.fold), len(needle), {ord(c) for c in WHITE}
    if nl > n:
        return None
    lo, hi = 0, n
    if mode in (Mode.PREFIX, Mode.EXACT) and needle[0] not in white:
        while lo < n and row.fold[lo] in white:
            lo += 1
    if mode in (Mode.POSTFIX, Mode.EXACT) and needle[-1] not in white:
        while hi > lo and row.fold[hi - 1] in white:
            hi -= 1
    if mode == Mode.SUBSTRING:
        return best_occurrence(row, needle)
    if mode == Mode.EXACT and hi - lo != nl or hi - lo < nl:
        return None
    start = hi - nl if mode == Mode.POSTFIX else lo
    return (start, start + nl) if row.fold[start : start + nl] == needle else None


def best_occurrence(row: Row, needle: list[int]) -> tuple[int, int] | None:
    """The first of the occurrences that begin with the largest bonus; a bonus of white space's worth ends the search."""
    nl, best, at = len(needle), -1, None
    if nl == len(row.fold):
        return (0, nl) if row.fold == needle else None
    i = -1
    while True:
        try:
            i = row.fold.index(needle[0], i + 1, len(row.fold) - nl + 1)
        except ValueError:
            break
        if row.fold[i : i + nl] == needle and row.full[i] > best:
            best, at = row.full[i], i
            if best >= row.preset.white_bonus:
                break
    return None if at is None else (at, at + nl)


def fast_cells(row: Row, needle: list[int], start: int, end: int) -> int:
    """The fast model over a window, one text at a time: the plain form of ``_dp``."""
    before: dict[int, int] = {}
    for k, c in enumerate(needle):
        now: dict[int, int] = {}
        reach, seen = -1, []
        for i in range(start, end):
            if i - 2 in before:
                seen.append(before[i - 2] + i - 2)
                reach = max(seen[-1], reach)
            if row.fold[i] != c:
                continue
            b = row.fast[i]
            if k == 0:
                now[i] = MATCH + 2 * b
                continue
            options = [before[i - 1] + max(b, CONSECUTIVE)] if i - 1 in before else []
            if seen and reach - i - 1 > 0:
                options.append(reach - i - 1 + b)
            if options:
                now[i] = MATCH + max(options)
        before = now
    best = max(before.values(), default=-1)
    return best if best < 0 or not row.preset.prefer_prefix else min(TOP, best + prefix_bonus(start))


def nucleo_cells(row: Row, needle: list[int], start: int, end: int) -> tuple[int, list[int]]:
    """The full model over a window, with the positions of its best reading (ties: the last column; a gap's later origin loses)."""
    head = 16 if start == 0 else max(0, 13 - (start - 1))
    levels: list[dict[int, tuple[int, int, int]]] = []  # position -> score, run bonus, position before
    for k, c in enumerate(needle):
        now: dict[int, tuple[int, int, int]] = {}
        before = levels[-1] if levels else {}
        reach, origin = None, -1
        for i in range(start, end):
            if i - 2 in before and (reach is None or before[i - 2][0] + i - 2 > reach):
                reach, origin = before[i - 2][0] + i - 2, i - 2
            if row.fold[i] != c:
                continue
            b = row.full[i]
            if k == 0:
                now[i] = (MATCH + 2 * b + (max(0, head - (i - start)) // 2 if row.preset.prefer_prefix else 0), b, -1)
                continue
            gap = None if reach is None else max(0, reach - i - 1)
            if i - 1 in before:
                d, run, _ = before[i - 1]
                run = max(run, CONSECUTIVE)
                run = b if b >= BOUNDARY and b > run else run
                value = d + max(run, b)
                if gap is None or value > gap + b:
                    now[i] = (value + MATCH, run, i - 1)
                    continue
            if gap is not None:
                now[i] = (gap + b + MATCH, b, origin)
        levels.append(now)
    if not levels[-1]:
        return -1, []
    best = max(v[0] for v in levels[-1].values())
    at = [max(i for i, v in levels[-1].items() if v[0] == best)]
    for level in reversed(levels[1:]):
        at.append(level[at[-1]][2])
    return min(TOP, best), at[::-1]


def match_row(row: Row, needle: list[int], mode: Mode, scoring: Scoring) -> tuple[int, list[int]]:
    """Score (-1: no match) and positions of one atom in one text."""
    n, nl = len(row.fold), len(needle)
    if nl > n:
        return -1, []
    found: tuple[int, list[int]] | None = None
    if mode != Mode.FUZZY or nl == 1 or nl == n:
        window = literal_window(row, needle, Mode.SUBSTRING if mode == Mode.FUZZY else mode)
        found = window_score(row, needle, *window) if window else (-1, [])
    elif (window := subsequence(row, needle)) is None:
        found = (-1, [])
    else:
        start, first_end, end = window
        if scoring == Scoring.OFF:
            at, i = [], start - 1
            for c in needle:
                i = row.fold.index(c, i + 1)
                at.append(i)
            found = (0, at)
        elif scoring == Scoring.FAST:
            reading = greedy(row, needle, start, first_end)
            found = reading if too_large(end - start, nl) else (fast_cells(row, needle, start, end), reading[1])
        elif end - start == nl:
            found = window_score(row, needle, start, end)
        elif too_large(end - start, nl):
            found = greedy(row, needle, start, first_end)
        else:
            found = nucleo_cells(row, needle, start, end)
            if found[0] < 0:
                found = (-1, [])
    if found[0] < 0:
        return -1, []
    return (0 if scoring == Scoring.OFF else found[0]), found[1]


class Batch:
    """Texts as one array of code points, with the bonuses and folds that atoms ask for."""

    def __init__(self, texts: list[str], preset: Preset):
        self.preset, self.n = preset, len(texts)
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self._folds, self._bonus, self._rows = {}, {}, None

    def fold(self, atom: Atom) -> np.ndarray:
        key = (atom.ignore_case, atom.normalize)
        if key not in self._folds:
            self._folds[key] = fold_table(*key, self.preset.unicode)[self.cps]
        return self._folds[key]

    def bonus(self, fast: bool) -> np.ndarray:
        if fast not in self._bonus:
            own = class_table(self.preset)[self.cps].astype(np.int64)
            before = np.concatenate(([0], own[:-1])) if len(own) else own
            before[self.starts[:-1][self.lengths > 0]] = self.preset.initial
            self._bonus[fast] = bonus_table(self.preset, fast)[before, own]
        return self._bonus[fast]

    def bonus_at(self, fast: bool, positions: np.ndarray, own: np.ndarray) -> np.ndarray:
        """``bonus`` of some positions, of the rows ``own``: most characters of a text are never asked for."""
        table = class_table(self.preset)
        before = np.where(positions == self.starts[own], int(self.preset.initial), table[self.cps[np.maximum(positions - 1, 0)]])
        return bonus_table(self.preset, fast)[before, table[self.cps[positions]]]

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        if self._rows is None:
            self._rows = np.repeat(np.arange(self.n), self.lengths)
        return self._rows[positions]

    def row(self, i: int, atom: Atom) -> Row:
        a, b = self.starts[i], self.starts[i + 1]
        return Row(self.fold(atom)[a:b].tolist(), self.bonus(False)[a:b].tolist(), self.bonus(True)[a:b].tolist(), self.preset)


def scores(batch: Batch, atom: Atom, scoring: Scoring) -> np.ndarray:
    """One atom's score in every text of the batch, -1 without a match."""
    needle = [*map(ord, atom.needle)]
    nl = len(needle)
    out = np.full(batch.n, -1, dtype=np.int64)
    plain = batch.lengths == nl if atom.mode == Mode.FUZZY and nl > 1 else batch.lengths >= nl
    if scoring == Scoring.OFF or atom.mode != Mode.FUZZY or nl == 1:
        rest = plain | (batch.lengths >= nl)
    else:
        rest = plain
        _dp(batch, atom, needle, scoring, out)
    if not rest.any():
        return out
    fold = batch.fold(atom)
    hit = np.zeros(batch.n, dtype=bool)
    hit[batch.rows_of(np.flatnonzero(fold == needle[0]))] = True
    for i in np.flatnonzero(rest & hit):
        out[i] = match_row(batch.row(i, atom), needle, atom.mode, scoring)[0]
    return out


def _last_at_most(sorted_positions: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(sorted_positions, x, side="right") - 1


def _greedy(batch: Batch, needle: list[int], places: dict[int, np.ndarray], rows: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Scores of ``greedy`` in all ``rows``, whose leftmost readings end at ``last``: only places of the needle's characters are visited."""
    at = last
    for c in needle[-2::-1]:  # backwards from the end
        at = places[c][_last_at_most(places[c], at - 1)]
    start, b = at, batch.bonus_at(False, at, rows)
    score, lead = MATCH + 2 * b, b
    for c in needle[1:]:
        before, at = at, places[c][np.searchsorted(places[c], at, side="right")]
        b, gap = batch.bonus_at(False, at, rows), at - before - 1
        lead = np.where((gap > 0) | (b >= BOUNDARY) & (b > lead), b, lead)
        gain = np.where(gap > 0, b, np.maximum(np.maximum(b, lead), CONSECUTIVE))
        lost = np.where(gap > 0, GAP_START + (gap - 1) * GAP_MORE, 0)
        score = np.minimum(TOP, np.maximum(0, score - lost) + MATCH + gain)
    if batch.preset.prefer_prefix:
        s = start - batch.starts[rows]
        score = np.minimum(TOP, score + np.where(s == 0, PREFIX_MOST, np.maximum(0, 13 - np.minimum(s - 1, TOP)) // 2))
    return score


def _dp(batch: Batch, atom: Atom, needle: list[int], scoring: Scoring, out: np.ndarray) -> None:
    """Scores of all texts longer than the needle at once, those of the greedy reading too."""
    fold, fast = batch.fold(atom), scoring == Scoring.FAST
    places = {c: np.flatnonzero(fold == c) for c in set(needle)}
    if not all(len(p) for p in places.values()):
        return
    rows = np.flatnonzero(batch.lengths > len(needle))
    at = batch.starts[rows] - 1
    start = None
    for c in needle:  # the leftmost reading
        p = places[c]
        k = np.searchsorted(p, at, side="right")
        there = k < len(p)
        at = p[np.minimum(k, len(p) - 1)]
        there &= at < batch.starts[rows + 1]
        rows, at = rows[there], at[there]
        start = at.copy() if start is None else start[there]
    if not len(rows):
        return
    p = places[needle[-1]]
    end = p[_last_at_most(p, batch.starts[rows + 1] - 1)] + 1
    width = end - start
    nl = len(needle)
    large = (width * nl > MATRIX_CELLS) | (width > WINDOW_CELLS) | (nl > NEEDLE_CELLS)
    if not fast:
        large |= width == nl
    if large.any():
        out[rows[large]] = _greedy(batch, needle, places, rows[large], at[large])
    rows, start, end = rows[~large], start[~large], end[~large]
    if not len(rows):
        return
    lo, hi = np.full(batch.n, len(fold)), np.zeros(batch.n, dtype=np.int64)
    lo[rows], hi[rows] = start, end
    far = np.int64(1) << 40
    for k, c in enumerate(needle):
        q = places[c]
        own = batch.rows_of(q)
        inside = (q >= lo[own]) & (q < hi[own])
        q, own = q[inside], own[inside]
        b = batch.bonus_at(fast, q, own)
        if k == 0:
            score, run = MATCH + 2 * b, b
            if batch.preset.prefer_prefix and not fast:
                s = lo[own] - batch.starts[own]
                head = np.where(s == 0, 16, np.maximum(0, 13 - (s - 1)))
                score = score + np.maximum(0, head - (q - lo[own])) // 2
        else:
            reach = np.maximum.accumulate(score_before + p_before + own_before * far) if len(p_before) else p_before
            i = _last_at_most(p_before, q - 1)
            beside = (i >= 0) & (p_before[np.maximum(i, 0)] == q - 1) if len(p_before) else np.zeros(len(q), bool)
            beside &= q > lo[own]
            j = _last_at_most(p_before, q - 2)
            gapped = (j >= 0) & (own_before[np.maximum(j, 0)] == own) if len(p_before) else np.zeros(len(q), bool)
            gap = np.where(gapped, reach[np.maximum(j, 0)] - own * far - q - 1, -1) if len(p_before) else np.full(len(q), -1)
            d = score_before[np.maximum(i, 0)] if len(p_before) else np.zeros(len(q), np.int64)
            if fast:
                gapped &= gap > 0
                score = MATCH + np.maximum(np.where(beside, d + np.maximum(b, CONSECUTIVE), -far), np.where(gapped, gap + b, -far))
                run = b
            else:
                gap = np.maximum(gap, 0)
                cb = np.maximum(run_before[np.maximum(i, 0)] if len(p_before) else b, CONSECUTIVE)
                cb = np.where((b >= BOUNDARY) & (b > cb), b, cb)
                value = d + np.maximum(cb, b)
                take = beside & (~gapped | (value > gap + b))
                score = MATCH + np.where(take, value, gap + b)
                run = np.where(take, cb, b)
            legal = beside | gapped
            q, own, score, run = q[legal], own[legal], score[legal], run[legal]
        p_before, own_before, score_before, run_before = q, own, score, run
    np.maximum.at(out, own_before, np.minimum(score_before, TOP))
    if fast and batch.preset.prefer_prefix:
        hit = rows[out[rows] >= 0]
        s = lo[hit] - batch.starts[hit]
        out[hit] = np.minimum(TOP, out[hit] + np.where(s == 0, PREFIX_MOST, np.maximum(0, 13 - (s - 1)) // 2))


def score_texts(texts: list[str], atoms: tuple[Atom, ...], scoring: Scoring, preset: Preset) -> np.ndarray:
    """Sums of the positive atoms' scores, -1 where one does not match or a negative one does."""
    parts, size = [0], 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            parts.append(i)
            size = 0
        size += len(text)
    return np.concatenate([_score_part(texts[a:b], atoms, scoring, preset) for a, b in zip(parts, [*parts[1:], len(texts)])])


def _score_part(texts: list[str], atoms: tuple[Atom, ...], scoring: Scoring, preset: Preset) -> np.ndarray:
    batch = Batch(texts, preset)
    total, alive = np.zeros(batch.n, dtype=np.int64), np.ones(batch.n, dtype=bool)
    for a in atoms:
        s = scores(batch, a, Scoring.OFF if a.negative else scoring)
        alive &= (s < 0) if a.negative else (s >= 0)
        if not a.negative:
            total += s
    return np.where(alive, np.minimum(total, 2**31 - 1), -1)


def positions(text: str, atoms: tuple[Atom, ...], scoring: Scoring, preset: Preset) -> list[int]:
    """Sorted distinct code point positions of all positive atoms in a text that matches."""
    batch, out = Batch([text], preset), set()
    for a in atoms:
        if not a.negative:
            out.update(match_row(batch.row(0, a), [*map(ord, a.needle)], a.mode, scoring)[1])
    return sorted(out)
