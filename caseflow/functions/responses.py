"""Parse model answer texts into coded fields (one response text per field)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.fields import int_or_null

FIELDS = ["summary", "substance", "safety", "io", "sports", "time", "date", "ampm", "area", "location"]


def _na(c: Column) -> Column:
    """Trimmed value; the "not applicable" answer (N\\A or N/A) becomes null."""
    t = F.trim(c)
    return F.when(t.isin("N\\A", "N/A"), F.lit(None)).otherwise(t)


def after_colon(r: Column) -> Column:
    """Second ``:``-separated field with ``}`` removed, trimmed (null when absent)."""
    return F.trim(F.regexp_replace(F.get(F.split(r, ":"), 1), "}", ""))


def braces(r: Column) -> Column:
    return F.regexp_extract(r, r"\{[^}]*\}", 0)


def parse_summary(r: Column) -> Column:
    j = F.get_json_object(r, "$.summary")
    stripped = F.regexp_replace(F.regexp_replace(r, "summary", ""), "[{}':]", "")
    return F.trim(F.when(j.isNotNull(), j).otherwise(stripped))


def parse_substance(r: Column) -> tuple[Column, Column]:
    lines = F.split(braces(r), "\n")
    s = F.trim(F.regexp_replace(F.get(F.split(F.get(lines, 0), ":"), 1), ",", ""))
    i = _na(F.regexp_replace(F.get(F.split(F.get(lines, 1), ":"), 1), "}", ""))
    ok = s.isNotNull() & F.get(F.split(F.get(lines, 1), ":"), 1).isNotNull()
    return F.when(ok, s), F.when(ok, i)


def parse_safety(r: Column) -> list[Column]:
    lines = F.split(braces(r), "\n")
    raw = [F.get(F.split(F.get(lines, k), ":"), 1) for k in range(5)]
    ok = raw[0].isNotNull() & raw[1].isNotNull() & raw[2].isNotNull() & raw[3].isNotNull() & raw[4].isNotNull()
    s1 = F.trim(raw[0])
    rest = [_na(raw[1]), _na(raw[2]), _na(raw[3]), _na(F.regexp_replace(raw[4], "}", ""))]
    out = [F.when(ok, s1)]
    for v in rest:
        out.append(F.when(ok & (s1 != "-1"), v))
    return out


def parse_time(r: Column) -> tuple[Column, Column]:
    parts = F.split(r, ":")
    h = F.trim(F.regexp_replace(F.get(parts, 1), r"\.0", ""))
    m = F.trim(F.regexp_replace(F.regexp_replace(F.get(parts, 2), "}", ""), r"\.0$", ""))
    ok = h.isNotNull() & m.isNotNull()
    return (F.when(ok & (h != "99"), h), F.when(ok & (m != "99"), m))


def parse_int_field(r: Column, missing: str = "99") -> Column:
    v = after_colon(r)
    return F.when(v != missing, int_or_null(v))


def parse_zero_null(r: Column) -> Column:
    v = after_colon(r)
    return F.when(v != "0", v)


def label_to_code(label: Column, mapping: dict[int, int]) -> Column:
    """``LABEL_n`` → the configured code for class n."""
    idx = F.regexp_replace(label, "^LABEL_", "").try_cast("int")
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, idx)


def positive_probability(label_idx: Column, score: Column) -> Column:
    """Probability of the positive class from the top label and its score."""
    return F.when(label_idx == 0, F.lit(1.0) - score).otherwise(score)


def two_logit_relevance(no_logit: Column, yes_logit: Column) -> Column:
    """softmax([no, yes])[yes] written as a logistic of the difference."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no_logit - yes_logit))
