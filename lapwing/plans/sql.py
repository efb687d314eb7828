"""Pieces of DuckDB SQL that the queries' oracles share."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(words: Iterable[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def fold(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def norm(c: str) -> str:
    return fold(f"regexp_replace(regexp_replace(lower({c}), '[''’]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g')")


def toks(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda tk: tk <> '')"


def js1(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


def js0(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def rlike(c: str, p: str) -> str:
    return f"regexp_matches({c}, {quoted(p)})"
