"""Column expressions for single fields (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scramble_id(c) -> Column:
    """Swap the last two digits of the key and append (their sum mod 10)."""
    s = F.trim(_c(c).cast("string"))
    n = F.length(s)
    last, prev = F.substring(s, -1, 1), F.substring(s, -2, 1)
    check = ((last.try_cast("int") + prev.try_cast("int")) % 10).cast("string")
    return F.concat(F.substring(s, F.lit(1), n - 2), last, prev, check)


def truncate_postal(c) -> Column:
    """Seven characters with a blank at position 4 → the first three."""
    c = _c(c)
    return F.when((F.length(c) == 7) & (F.substring(c, 4, 1) == " "), F.substring(c, 1, 3)).otherwise(c)


def age_years(arrival, dob) -> Column:
    return F.floor(F.datediff(_c(arrival), _c(dob)) / 365).cast("int")


def weekday_name(c) -> Column:
    return F.date_format(_c(c), "EEEE")


def normalise_sex(c) -> Column:
    c = _c(c)
    return F.when(F.lower(c) == "male", "M").when(F.lower(c) == "female", "F").otherwise(c)


def triage_level(c) -> Column:
    """Blank → null, else the integer level (anything else becomes null)."""
    return int_or_null(c)


def whole_number(c, to: str) -> Column:
    """A cell as a whole number: digits, or a decimal with a whole value (``12.0``); words,
    fractions and numbers beyond the type are null."""
    c = F.trim(_c(c).cast("string"))
    return F.when(c.rlike(r"^[-+]?[0-9]+(\.0*)?$"), F.regexp_replace(c, r"\.0*$", "").try_cast(to))


def int_or_null(c) -> Column:
    """Numeric coercion used for every coded column: anything not a whole number → null."""
    return whole_number(c, "int")


def ampm_from_hour(c) -> Column:
    """Hour < 12 → 1, 12..23 → 2, another number stays as it is, anything else is null."""
    h = int_or_null(c)
    return F.when((h >= 0) & (h < 12), F.lit(1)).when((h >= 12) & (h < 24), F.lit(2)).otherwise(h)
