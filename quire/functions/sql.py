"""The scalar functions as DuckDB SQL, for the oracle."""

from __future__ import annotations

from .text import CAPITAL, FROM, ONE_TO_MANY, TO


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_symbols(x: str) -> str:
    for sign, words in ONE_TO_MANY.items():
        x = f"replace({x}, {q(sign)}, {q(words)})"
    return f"translate({x}, {q(FROM)}, {q(TO)})"


def squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace(translate({x}, chr(160) || chr(9), '  '), ' {{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def est_tokens(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    syllables = f"coalesce(list_sum(list_transform({words}, lambda w: 1 + length(w) // 7)), 0)"
    marks = f"length(regexp_replace({x}, '[\\p{{L}}\\p{{N}}\\s]', '', 'g'))"
    return f"CAST(CASE WHEN regexp_replace({x}, '\\s', '', 'g') = '' THEN 0 ELSE greatest(1, ceil(length({x}) / 2.8::DOUBLE), {syllables} + {marks}) END AS BIGINT)"


def split_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?;:])\\s+([{CAPITAL}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"


def norm_key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[0-9]+', '#', 'g')"
