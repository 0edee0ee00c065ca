"""Per-key text aggregation with a deterministic order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_join(order_cols: list[Column], text: Column, sep: str) -> Column:
    """Aggregate expression: texts of a group, sorted by ``order_cols`` then text, joined by ``sep``.

    ``collect_list`` of a struct sorted with ``array_sort``: the order is total, so
    the result does not depend on shuffle arrival order.
    """
    fields = [c.alias(f"k{i}") for i, c in enumerate(order_cols)] + [text.alias("t")]
    arr = F.array_sort(F.collect_list(F.struct(*fields)))
    return F.array_join(F.transform(arr, lambda s: s["t"]), sep)


def problem_list(problems: DataFrame, key: str = "encounter_id", col: str = "problem",
                 sep: str = ",") -> DataFrame:
    """One comma-joined problem list per key (sorted, so pairing is by key, never by position)."""
    return (problems.where(F.col(col).isNotNull())
            .groupBy(key).agg(ordered_join([], F.col(col), sep).alias("problem_list")))
