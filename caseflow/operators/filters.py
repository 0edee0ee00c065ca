"""Row filters: date windows, key lists, comparison operators, virtual column groups."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Comparison operators a structured filter may use; anything else is skipped.
OPS = {
    "gt": lambda c, v: c > F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "eq": lambda c, v: c == F.lit(v),
    "neq": lambda c, v: c != F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "like": lambda c, v: F.lower(c).contains(str(v).lower()),
    "not_like": lambda c, v: ~F.lower(c).contains(str(v).lower()),
}

# Columns that stand for several stored columns at once.
VIRTUAL_GROUPS = {
    "sd_all": ["sd1", "sd2", "sd3", "sd4", "sd5"],
    "no_all": ["no1", "no2", "no3"],
    "bp_all": ["bp1", "bp2", "bp3"],
}


def _as_date(v):
    return v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v))


def date_window(df: DataFrame, col: str, start, end) -> DataFrame:
    """Rows with ``col`` in [start, end], both days inclusive.

    Written as a half-open timestamp range on the raw column so the bounds reach
    the parquet reader as pushed filters (a cast to date would not).
    """
    lo = _as_date(start)
    hi = _as_date(end) + dt.timedelta(days=1)
    c = F.col(col)
    return df.where((c >= F.lit(dt.datetime.combine(lo, dt.time()))) &
                    (c < F.lit(dt.datetime.combine(hi, dt.time()))))


def key_list(df: DataFrame, keys: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Rows whose key is in a key DataFrame: a semi join, never a giant IN list."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def select_encounters(df: DataFrame, ts_col: str, keys: DataFrame | None = None, start=None, end=None,
                      key: str = "encounter_id") -> DataFrame:
    """Date window or key list; it is an error to give neither keys nor both dates."""
    if keys is not None:
        return key_list(df, keys, key)
    if start is None or end is None:
        raise ValueError("give a key list or both start and end dates")
    return date_window(df, ts_col, start, end)


def condition(column: Column, spec: dict) -> Column | None:
    """AND of every known operator in ``{op: value}``; unknown operators are skipped."""
    parts = [OPS[op](column, v) for op, v in spec.items() if op in OPS]
    return reduce(lambda a, b: a & b, parts) if parts else None


def group_condition(df: DataFrame, name: str, spec: dict) -> Column | None:
    """Filter over a virtual group: ``in`` = any member in the list, ``not_in`` = none is."""
    members = [F.col(c) for c in VIRTUAL_GROUPS[name] if c in df.columns]
    if not members:
        return None
    arr = F.array(*members)
    parts = []
    for op, v in spec.items():
        lit = F.array(*[F.lit(x) for x in v])
        if op == "in":
            parts.append(F.coalesce(F.arrays_overlap(arr, lit), F.lit(False)))
        elif op == "not_in":
            parts.append(~F.coalesce(F.arrays_overlap(arr, lit), F.lit(False)))
    return reduce(lambda a, b: a & b, parts) if parts else None


def table_condition(df: DataFrame, spec: dict) -> Column | None:
    """Conjunction over ``{column: {op: value}}``; unknown columns are skipped."""
    parts = []
    for col, ops in spec.items():
        if col in VIRTUAL_GROUPS:
            c = group_condition(df, col, ops)
        elif col in df.columns:
            c = condition(F.col(col), ops)
        else:
            c = None
        if c is not None:
            parts.append(c)
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_table_filter(df: DataFrame, spec: dict) -> DataFrame:
    cond = table_condition(df, spec)
    return df if cond is None else df.where(cond)


def filter_key_sets(tables: dict[str, DataFrame], filters: dict, key: str = "encounter_id",
                    restrict_to: DataFrame | None = None) -> DataFrame | None:
    """Keys passing every table's filter: the intersection over tables (semi-join chain).

    Unknown tables and tables without the key column are skipped; returns None
    when no table applies (no restriction).
    """
    result = None
    for name, spec in filters.items():
        t = tables.get(name)
        if t is None or key not in t.columns:
            continue
        keys = apply_table_filter(t, spec).select(key)
        if restrict_to is not None:
            keys = keys.join(restrict_to.select(key), key, "left_semi")
        keys = keys.distinct()
        result = keys if result is None else result.join(keys, key, "left_semi")
    return result
