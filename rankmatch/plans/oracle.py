"""DuckDB SQL of searches, written from the definitions: positions as rows, scores as window functions over them."""

from __future__ import annotations

from ..functions.chars import WHITE, fold_cp, folds, strips
from ..functions.options import DEFAULT, Case, Mode, Norm, Preset, Scoring
from ..functions.predicates import regex_of
from ..functions.query import Atom, parse


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def folded(text: str, atom: Atom) -> str:
    pairs = [(c, fold_cp(c, atom.ignore_case, atom.normalize)) for c in sorted({*range(65, 91), *folds(), *strips()})]
    pairs = [(chr(a), chr(b)) for a, b in pairs if a != b]
    return f"translate({text}, {quote(''.join(a for a, _ in pairs))}, {quote(''.join(b for _, b in pairs))})" if pairs else text


def class_of(char: str, preset: Preset) -> str:
    return f"""CASE WHEN contains({quote(WHITE)}, {char}) THEN 0 WHEN contains({quote(preset.delimiters)}, {char}) THEN 2 WHEN regexp_matches({char}, '\\p{{N}}') THEN 6 WHEN regexp_matches({char}, '\\p{{Ll}}') THEN 3 WHEN regexp_matches({char}, '\\p{{Lu}}') THEN 4 WHEN regexp_matches({char}, '\\p{{L}}') THEN 5 ELSE 1 END"""


def full_bonus(p: str, c: str, preset: Preset) -> str:
    turn = f"(({p} = 3 AND {c} = 4) OR ({p} <> 6 AND {c} = 6))"
    return f"CASE WHEN {c} > 2 AND {p} = 0 THEN {preset.white_bonus} WHEN {c} > 2 AND {p} = 2 THEN {preset.delimiter_bonus} WHEN {c} > 2 AND {p} = 1 THEN 8 WHEN {turn} THEN 5 WHEN {c} = 0 THEN {preset.white_bonus} WHEN {c} = 1 THEN 8 ELSE 0 END"


def fast_bonus(p: str, c: str) -> str:
    return f"CASE WHEN {p} <= 2 AND {c} > 2 THEN 8 WHEN ({p} = 3 AND {c} = 4) OR ({p} <> 6 AND {c} = 6) THEN 7 ELSE 0 END"


def head_bonus(start: str, preset: Preset) -> str:
    """``start`` from 0."""
    return f"CASE WHEN {start} = 0 THEN 8 ELSE greatest(0, 13 - ({start} - 1)) // 2 END" if preset.prefer_prefix else "0"


def match_sql(text: str, atom: Atom) -> str:
    return f"(length({text}) >= {len(atom.needle)} AND regexp_matches({text}, {quote(regex_of(atom, possessive=False))}))"


def window_sql(rows: str, atom: Atom, start: str, preset: Preset) -> str:
    """(id, score) of contiguous windows: ``rows`` is a relation (id, t), ``start`` an expression from 0 over it."""
    n = len(atom.needle)
    chars = ", ".join(f"CASE WHEN s + {i} < 0 THEN {int(preset.initial)} ELSE {class_of(f'substr(t, s + {i + 1}, 1)', preset)} END AS c{i + 1}" for i in range(-1, n))
    sql = f"SELECT *, {chars} FROM (SELECT *, ({start})::INT AS s FROM ({rows}))"
    sql = f"SELECT *, {', '.join(f'{full_bonus(f'c{i}', f'c{i + 1}', preset)} AS b{i}' for i in range(n))} FROM ({sql})"
    sql = f"SELECT *, b0 AS l0, 16 + 2 * b0 AS v0 FROM ({sql})"
    for i in range(1, n):
        lead = f"CASE WHEN b{i} >= 8 AND b{i} > l{i - 1} THEN b{i} ELSE l{i - 1} END"
        sql = f"SELECT *, least(65535, v{i - 1} + 16 + greatest(b{i}, l{i}, 4)) AS v{i} FROM (SELECT *, {lead} AS l{i} FROM ({sql}))"
    return f"SELECT id, least(65535, v{n - 1} + {head_bonus('s', preset)})::INT AS score FROM ({sql})"


def literal_start(atom: Atom) -> str:
    """From 0, for rows that match."""
    white, n = quote(WHITE), len(atom.needle)
    if atom.mode == Mode.POSTFIX:
        return f"length({'t' if atom.needle[-1] in WHITE else f'rtrim(t, {white})'}) - {n}"
    return "0" if atom.needle[0] in WHITE else f"length(t) - length(ltrim(t, {white}))"


def occurrences_sql(rows: str, atom: Atom, preset: Preset) -> str:
    """Substring mode: the first start of the largest bonus, or the first that reaches white space's."""
    n = len(atom.needle)
    at = f"SELECT id, t, unnest(range(0, length(t) - {n} + 1)) AS s FROM (SELECT * FROM ({rows}) WHERE {match_sql('t', atom)})"
    at = f"SELECT * FROM ({at}) WHERE substr({folded('t', atom)}, (s + 1)::INT, {n}) = {quote(atom.needle)}"
    b = full_bonus("p", "c", preset)
    at = f"SELECT *, {b} AS b FROM (SELECT *, CASE WHEN s = 0 THEN {int(preset.initial)} ELSE {class_of('substr(t, s::INT, 1)', preset)} END AS p, {class_of('substr(t, (s + 1)::INT, 1)', preset)} AS c FROM ({at}))"
    best = f"SELECT id, t, s AS s0 FROM ({at}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY least(b, {preset.white_bonus}) DESC, s) = 1"
    return window_sql(best, atom, "s0", preset)


def fuzzy_sql(rows: str, atom: Atom, scoring: Scoring, preset: Preset) -> str:
    """Running maxima over positions, a column for each needle character. Windows beyond the size cap are not covered."""
    n = len(atom.needle)
    if n == 1:
        return occurrences_sql(rows, Atom(atom.needle, Mode.SUBSTRING, False, atom.ignore_case, atom.normalize), preset)
    first, last = quote(atom.needle[0]), quote(atom.needle[-1])
    fit = f"SELECT *, {folded('t', atom)} AS f FROM ({rows}) WHERE {match_sql('t', atom)}"
    equal = window_sql(f"SELECT id, t FROM ({fit}) WHERE length(t) = {n}", atom, "0", preset)
    win = f"SELECT id, t, f, instr(f, {first}) - 1 AS s, length(f) - instr(reverse(f), {last}) + 1 AS e FROM ({fit}) WHERE length(t) > {n}"
    parts = [equal]
    if scoring == Scoring.NUCLEO:
        parts.append(window_sql(f"SELECT id, t, s AS s0 FROM ({win}) WHERE e - s = {n}", atom, "s0", preset))
        win = f"SELECT * FROM ({win}) WHERE e - s > {n}"
    pos = f"SELECT id, s, i, substr(f, (i + 1)::INT, 1) AS f, CASE WHEN i = 0 THEN {int(preset.initial)} ELSE {class_of('substr(t, i::INT, 1)', preset)} END AS p, {class_of('substr(t, (i + 1)::INT, 1)', preset)} AS c FROM (SELECT *, unnest(range(s, e)) AS i FROM ({win}))"
    fast = scoring == Scoring.FAST
    sql = f"SELECT *, {fast_bonus('p', 'c') if fast else full_bonus('p', 'c', preset)} AS b FROM ({pos})"
    head = "greatest(0, CASE WHEN s = 0 THEN 16 ELSE greatest(0, 13 - (s - 1)) END - (i - s)) // 2" if preset.prefer_prefix and not fast else "0"
    sql = f"SELECT *, CASE WHEN f = {first} THEN 16 + 2 * b + {head} END AS h0, CASE WHEN f = {first} THEN b END AS r0 FROM ({sql})"
    for k in range(1, n):
        beside = "OVER (PARTITION BY id ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
        far = "OVER (PARTITION BY id ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"
        sql = f"SELECT *, max(h{k - 1}) {beside} AS d{k}, max(r{k - 1}) {beside} AS q{k}, max(h{k - 1} + i) {far} - i - 1 AS g{k} FROM ({sql})"
        mine = f"f = {quote(atom.needle[k])}"
        if fast:
            sql = f"SELECT *, CASE WHEN {mine} THEN 16 + greatest(d{k} + greatest(b, 4), CASE WHEN g{k} > 0 THEN g{k} + b END) END AS h{k}, 0 AS r{k} FROM ({sql})"
        else:
            run = f"CASE WHEN b >= 8 AND b > greatest(q{k}, 4) THEN b ELSE greatest(q{k}, 4) END"
            take = f"d{k} IS NOT NULL AND (g{k} IS NULL OR d{k} + greatest(u{k}, b) > greatest(g{k}, 0) + b)"
            sql = f"SELECT *, CASE WHEN {mine} THEN 16 + CASE WHEN {take} THEN d{k} + greatest(u{k}, b) WHEN g{k} IS NOT NULL THEN greatest(g{k}, 0) + b END END AS h{k}, CASE WHEN {take} THEN u{k} ELSE b END AS r{k} FROM (SELECT *, {run} AS u{k} FROM ({sql}))"
    add = head_bonus("any_value(s)", preset) if fast else "0"
    parts.append(f"SELECT id, least(65535, max(h{n - 1}) + {add})::INT AS score FROM ({sql}) GROUP BY id HAVING max(h{n - 1}) IS NOT NULL")
    return " UNION ALL ".join(parts)


def atom_sql(rows: str, atom: Atom, scoring: Scoring, preset: Preset) -> str:
    if scoring == Scoring.OFF:
        return f"SELECT id, 0 AS score FROM ({rows}) WHERE {match_sql('t', atom)}"
    if atom.mode == Mode.FUZZY:
        return fuzzy_sql(rows, atom, scoring, preset)
    if atom.mode == Mode.SUBSTRING:
        return occurrences_sql(rows, atom, preset)
    return window_sql(f"SELECT * FROM ({rows}) WHERE {match_sql('t', atom)}", atom, literal_start(atom), preset)


def search_sql(table: str, key: str, text: str, query: str, mode: Mode = Mode.FUZZY, scoring: Scoring = Scoring.FAST, case: Case = Case.SMART, norm: Norm = Norm.SMART, preset: Preset = DEFAULT, limit: int = 0) -> str:
    """(idx, score) of one key's search."""
    rows = f"SELECT {key} AS id, coalesce({text}::VARCHAR, '') AS t FROM {table}"
    atoms = parse(query, mode, case, norm, preset.unicode)
    for a in atoms:
        if a.negative:
            rows = f"SELECT * FROM ({rows}) WHERE NOT {match_sql('t', a)}"
    positive = [a for a in atoms if not a.negative]
    if not positive:
        sql = f"SELECT id AS idx, 0::INT AS score FROM ({rows})"
    else:
        each = [f"({atom_sql(rows, a, scoring, preset)}) AS a{i}" for i, a in enumerate(positive)]
        joined = each[0] + "".join(f" JOIN {e} USING (id)" for e in each[1:])
        sql = f"SELECT id AS idx, ({' + '.join(f'a{i}.score' for i in range(len(positive)))})::INT AS score FROM {joined}"
    order = "idx" if scoring == Scoring.OFF else "score DESC, idx"
    return f"SELECT * FROM ({sql}) ORDER BY {order} LIMIT {limit}" if limit else sql
