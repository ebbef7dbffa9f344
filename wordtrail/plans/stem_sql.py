"""Comparison SQL for the stemmers: one CTE per step, from the same suffix tables."""

from __future__ import annotations

from wordtrail.functions import stemming as st
from wordtrail.plans.registry import quoted_list

V, C, ONE, TWO = st.V, st.C, st.ONE, st.TWO


def _is(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _cut(n: int) -> str:
    return f"left(w, greatest(length(w) - {n}, 0))"


def _case(table: dict[str, str], value: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def _parts(suffixes) -> str:
    """stem and suf columns for the longest suffix."""
    pattern = "^(.*?)(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$"
    return f"regexp_extract(w, '{pattern}', 1) AS stem, regexp_extract(w, '{pattern}', 2) AS suf"


def _short(text: str) -> str:
    return _is(text, f"{C}{V}[^aeiouywxY]$|^{V}{C}$")


def _chain(start: str, prefix: str, steps: list[tuple[str, str]]) -> tuple[str, str]:
    """CTEs adding the columns of the first part, then replacing w by the second."""
    ctes, source = [], start
    for i, (columns, value) in enumerate(steps):
        name = f"{prefix}{i}"
        inner = f"(SELECT *{', ' + columns if columns else ''} FROM {source})"
        drop = [c.split(" AS ")[-1].strip() for c in columns.split(", ") if c.split(" AS ")[-1].strip() in ("stem", "suf", "cut")]
        keep = f"* EXCLUDE (w{''.join(', ' + d for d in drop)})"
        ctes.append(f"{name} AS (SELECT {keep}, {value} AS w FROM {inner})")
        source = name
    return ",\n".join(ctes), source


def _finish(source: str, irregular: dict[str, str]) -> str:
    return (f"SELECT token, CASE WHEN length(token) <= 2 THEN token WHEN token IN ({quoted_list(irregular)}) THEN "
            f"{_case(irregular, 'token')} ELSE lower(w) END AS stem FROM {source}")


MARK_Y = ("", "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g')")


def _repair(double: str, short: str) -> str:
    return (f"CASE WHEN {_is('cut', '(at|bl|iz)$')} THEN cut || 'e' WHEN {_is('cut', double)} THEN left(cut, length(cut) - 1) "
            f"WHEN {short} THEN cut || 'e' ELSE cut END")


def porter_ctes(vocabulary: str) -> str:
    """``stems(token, stem)`` from ``vocabulary(token)``."""
    past = f"CASE WHEN w LIKE '%ed' THEN {_cut(2)} WHEN w LIKE '%ing' THEN {_cut(3)} ELSE w END AS cut"
    repaired = _repair(st.DOUBLE, f"{_is('cut', ONE)} AND NOT {_is('cut', TWO)} AND {_short('cut')}")
    steps = [
        MARK_Y,
        ("", f"CASE WHEN w LIKE '%sses' THEN {_cut(2)} WHEN w LIKE '%ies' THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END "
             f"WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_cut(1)} ELSE w END"),
        (past, f"CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END "
               f"WHEN w LIKE '%eed' THEN CASE WHEN {_is(_cut(3), ONE)} THEN {_cut(1)} ELSE w END "
               f"WHEN (w LIKE '%ed' OR w LIKE '%ing') AND {_is('cut', V)} THEN {repaired} ELSE w END"),
        ("", f"CASE WHEN {_is('w', f'.{C}y$')} THEN {_cut(1)} || 'i' ELSE w END"),
        ("", f"CASE WHEN w LIKE '%alli' AND {_is(_cut(4), ONE)} THEN {_cut(2)} ELSE w END"),
        (_parts(st.PORTER_STEP2), f"CASE WHEN suf <> '' AND {_is('stem', ONE)} THEN stem || {_case(st.PORTER_STEP2, 'suf')} ELSE w END"),
        ("", f"CASE WHEN w LIKE '%logi' AND {_is(_cut(3), ONE)} THEN {_cut(1)} ELSE w END"),
        (_parts(st.PORTER_STEP3), f"CASE WHEN suf <> '' AND {_is('stem', ONE)} THEN stem || {_case(st.PORTER_STEP3, 'suf')} ELSE w END"),
        (_parts(st.PORTER_STEP4), f"CASE WHEN suf <> '' AND {_is('stem', TWO)} AND (suf <> 'ion' OR {_is('stem', '[st]$')}) THEN stem ELSE w END"),
        ("", f"CASE WHEN w LIKE '%e' AND ({_is(_cut(1), TWO)} OR {_is(_cut(1), ONE)} AND NOT {_short(_cut(1))}) THEN {_cut(1)} ELSE w END"),
        ("", f"CASE WHEN w LIKE '%ll' AND {_is(_cut(1), TWO)} THEN {_cut(1)} ELSE w END"),
    ]
    chain, last = _chain("p_start", "p_", steps)
    return (f"p_start AS (SELECT token, lower(token) AS w FROM {vocabulary}),\n{chain},\n"
            f"stems AS ({_finish(last, st.PORTER_IRREGULAR)})")


def porter2_ctes(vocabulary: str) -> str:
    first, last_1 = _chain("q_start", "q_", [
        MARK_Y, ("", "regexp_replace(w, '(''s''|''s|'')$', '')"),
        ("", f"CASE WHEN w LIKE '%sses' THEN {_cut(2)} WHEN {_is('w', '(ied|ies)$')} THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END "
             f"WHEN {_is('w', '(us|ss)$')} THEN w WHEN w LIKE '%s' AND {_is(_cut(2), V)} THEN {_cut(1)} ELSE w END")])
    head = f"regexp_extract(w, '^(gener|commun|arsen|{C}*{V}+{C})', 1)"
    r1 = f"CASE WHEN {head} = '' THEN length(w) ELSE length({head}) END"
    more = f"regexp_extract(substr(w, r1 + 1), '^{C}*{V}+{C}')"
    regions = (f"q_r1 AS (SELECT *, {r1} AS r1, w AS plural FROM {last_1}),\n"
               f"q_r2 AS (SELECT *, CASE WHEN {more} = '' THEN length(w) ELSE r1 + length({more}) END AS r2 FROM q_r1)")
    repaired = _repair("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", f"length(cut) <= r1 AND {_short('cut')}")
    second, last_2 = _chain("q_r2", "r_", [
        (_parts(["eed", "eedly", "ed", "edly", "ing", "ingly"]) + ", regexp_replace(w, '(ed|edly|ing|ingly)$', '') AS cut",
         f"CASE WHEN suf = '' THEN w WHEN suf IN ('eed', 'eedly') THEN CASE WHEN length(stem) >= r1 THEN stem || 'ee' ELSE w END "
         f"WHEN {_is('stem', V)} THEN {repaired} ELSE w END"),
        ("", f"CASE WHEN {_is('w', f'.{C}[yY]$')} THEN {_cut(1)} || 'i' ELSE w END"),
        (_parts([*st.PORTER2_STEP2, "ogi", "li"]),
         f"CASE WHEN suf = '' OR length(stem) < r1 THEN w WHEN suf = 'ogi' THEN CASE WHEN stem LIKE '%l' THEN {_cut(1)} ELSE w END "
         f"WHEN suf = 'li' THEN CASE WHEN {_is('stem', '[cdeghkmnrt]$')} THEN stem ELSE w END ELSE stem || {_case(st.PORTER2_STEP2, 'suf')} END"),
        (_parts([*st.PORTER2_STEP3, "ative"]),
         f"CASE WHEN suf = '' OR length(stem) < r1 THEN w WHEN suf = 'ative' THEN CASE WHEN length(stem) >= r2 THEN stem ELSE w END "
         f"ELSE stem || {_case(st.PORTER2_STEP3, 'suf')} END"),
        (_parts([*st.PORTER2_STEP4, "ion"]),
         f"CASE WHEN suf <> '' AND length(stem) >= r2 AND (suf <> 'ion' OR {_is('stem', '[st]$')}) THEN stem ELSE w END"),
        ("", f"CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {_short(_cut(1))}) THEN {_cut(1)} "
             f"WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN {_cut(1)} ELSE w END"),
    ])
    kept = f"q_end AS (SELECT token, CASE WHEN plural IN ({quoted_list(st.PORTER2_KEPT)}) THEN plural ELSE w END AS w FROM {last_2})"
    return (f"q_start AS (SELECT token, regexp_replace(lower(token), '^''', '') AS w FROM {vocabulary}),\n{first},\n{regions},\n{second},\n{kept},\n"
            f"stems AS ({_finish('q_end', st.PORTER2_IRREGULAR)})")
