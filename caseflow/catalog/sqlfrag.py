"""DuckDB SQL fragments shared by oracle queries (oracle side only)."""

from __future__ import annotations

from caseflow.rules.stopwords import ENGLISH_STOP_WORDS

STOP_LIST = "[" + ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS) + "]"


def terms(text: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), "
            f"lambda t: NOT list_contains({STOP_LIST}, t)))")


def tokens(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), "
            f"lambda t: NOT list_contains({STOP_LIST}, t))")


def _fold(a: str, b: str, expr: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: {expr}), "
            f"lambda acc, v: acc + v, CAST(0.0 AS DOUBLE))")


def dot(a: str, b: str) -> str:
    return _fold(a, b, "CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)")


def cosine_distance(a: str, b: str) -> str:
    return f"(1.0 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


def l2(a: str, b: str) -> str:
    return f"sqrt({_fold(a, b, '(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))')})"


def l1(a: str, b: str) -> str:
    return _fold(a, b, "abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))")


def sql_str_list(xs) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"
