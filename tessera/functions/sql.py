"""The text functions in DuckDB's SQL, for the oracles."""

from __future__ import annotations

from tessera.functions import lexicon as L


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def fold(x: str) -> str:
    return f"translate({x}, '{L.ACCENTED}', '{L.UNACCENTED}')"


def content(words: str) -> str:
    return f"list_filter({words}, lambda w: NOT list_contains({texts(L.STOP_WORDS)}, w))"


def stem(x: str) -> str:
    for _ in range(3):
        x = f"(SELECT CASE WHEN t LIKE '%ies' AND length(t) >= 5 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%sses' THEN left(t, length(t) - 2) ELSE regexp_replace(t, '{L.STEM_SUFFIX}', '\\1') END FROM (SELECT {x} AS t))"
    return x


def stem_case(x: str) -> str:
    """One pass, for use where the input is a plain column."""
    return f"CASE WHEN {x} LIKE '%ies' AND length({x}) >= 5 THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%sses' THEN left({x}, length({x}) - 2) ELSE regexp_replace({x}, '{L.STEM_SUFFIX}', '\\1') END"


def stems(words: str) -> str:
    for _ in range(3):
        words = f"list_transform({words}, lambda t: {stem_case('t')})"
    return words


def token_estimate(x: str) -> str:
    other = f"length(regexp_replace({x}, '{L.CJK_CLASS}', '', 'g'))"
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE length({x}) - {other} + ceil({other} / 4.0) + 1 END)::BIGINT"


def squeeze(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"


def preview(x: str, limit: int = 220) -> str:
    flat = squeeze(x)
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE regexp_replace(left({flat}, {limit}), ' [^ ]*$', '') || '…' END"
