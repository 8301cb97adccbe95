"""Porter stems as DuckDB SQL, written apart from the function they are to check: shapes of words and patterns over them."""

from __future__ import annotations

from starloom.functions.stemming import STEP2, STEP3, STEP4


def _shape(x: str) -> str:
    """V for each vowel, C for each other letter; y after a C is a vowel."""
    marked = f"regexp_replace(regexp_replace({x}, '([^aeiouy])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    return f"regexp_replace(regexp_replace({marked}, '[^aeiouY]', 'C', 'g'), '[aeiouY]', 'V', 'g')"


def _over(n: int, x: str) -> str:
    """Whether the measure of x is over n."""
    return f"regexp_matches({_shape(x)}, '{'V+C+' * n}V+C')"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _short(x: str) -> str:
    return f"(regexp_matches({_shape(x)}, 'CVC$') AND NOT regexp_matches({x}, '[wxy]$'))"


def _once(x: str) -> str:
    return f"({_over(0, x)} AND NOT {_over(1, x)})"


def _swap(table: dict[str, str]) -> str:
    """The longest suffix of the table, swapped if the measure before it is over 0."""
    cases = [f"WHEN w LIKE '%{s}' THEN CASE WHEN {_over(0, _cut(len(s)))} THEN {_cut(len(s))} || '{put}' ELSE w END" for s, put in sorted(table.items(), key=lambda x: -len(x[0]))]
    return f"CASE {' '.join(cases)} ELSE w END"


def stem_ctes(source: str) -> str:
    """Common table expressions that end in stems(word, stem) for the words of a query that gives them as column word."""
    drop = " ".join(f"WHEN w LIKE '%{s}' THEN CASE WHEN {_over(1, _cut(len(s)))}{' AND regexp_matches(' + _cut(3) + ', ' + chr(39) + '[st]$' + chr(39) + ')' if s == 'ion' else ''} THEN {_cut(len(s))} ELSE w END" for s in sorted(STEP4, key=lambda x: -len(x)))
    mend = f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '[^aeiou]$') AND right(w, 1) = left(right(w, 2), 1) AND right({_shape('w')}, 1) = 'C' AND NOT regexp_matches(w, '[lsz]$') THEN {_cut(1)} WHEN {_once('w')} AND {_short('w')} THEN w || 'e' ELSE w END"
    ends = lambda s: f"w LIKE '%{s}' AND contains({_shape(_cut(len(s)))}, 'V')"
    steps = [
        f"SELECT word, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {_cut(1)} ELSE w END AS w, FALSE AS mend FROM porter0",
        f"SELECT word, CASE WHEN w LIKE '%eed' THEN CASE WHEN {_over(0, _cut(3))} THEN {_cut(1)} ELSE w END WHEN {ends('ed')} THEN {_cut(2)} WHEN {ends('ing')} THEN {_cut(3)} ELSE w END AS w, w NOT LIKE '%eed' AND (({ends('ed')}) OR ({ends('ing')})) AS mend FROM porter1",
        f"SELECT word, CASE WHEN mend THEN {mend} ELSE w END AS w FROM porter2",
        f"SELECT word, CASE WHEN w LIKE '%y' AND contains({_shape(_cut(1))}, 'V') THEN {_cut(1)} || 'i' ELSE w END AS w FROM porter3",
        f"SELECT word, {_swap(STEP2)} AS w FROM porter4",
        f"SELECT word, {_swap(STEP3)} AS w FROM porter5",
        f"SELECT word, CASE {drop} ELSE w END AS w FROM porter6",
        f"SELECT word, CASE WHEN w LIKE '%e' AND ({_over(1, _cut(1))} OR ({_once(_cut(1))} AND NOT {_short(_cut(1))})) THEN {_cut(1)} ELSE w END AS w FROM porter7",
        f"SELECT word, CASE WHEN w LIKE '%ll' AND {_over(1, 'w')} THEN {_cut(1)} ELSE w END AS w FROM porter8",
    ]
    chain = ", ".join(f"porter{k} AS ({s})" for k, s in enumerate(steps, 1))
    return f"vocabulary AS (SELECT DISTINCT word FROM ({source})), porter0 AS (SELECT word, word AS w FROM vocabulary WHERE regexp_matches(word, '^[a-z][a-z][a-z]+$')), {chain}, stems AS (SELECT word, w AS stem FROM porter{len(steps)} UNION ALL SELECT word, word FROM vocabulary WHERE NOT regexp_matches(word, '^[a-z][a-z][a-z]+$'))"
