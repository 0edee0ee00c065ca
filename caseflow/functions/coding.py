"""Coded fields derived from free text: body part, nature of injury, disposition.

Every test is a substring test on the lower-cased diagnosis, and the first rule
that fires wins. The rules are a table in ``rules.injury``; here each table becomes one
ordered ``CASE``, handed to Spark as one SQL expression.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.rules.conditions import has, has_all
from caseflow.rules.injury import BODY_PART_ROWS, LOOKUP, NATURE_ROWS
from caseflow.rules.vocab import DISP_ADMITTED, DISP_LEFT


def _case(rows: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in rows) + f" ELSE {default} END"


@cache
def body_part_sql(column: str) -> str:
    """Body part code of a lower-cased diagnosis column, as SQL."""
    return _case([(cond.sql(column), str(code)) for code, cond in BODY_PART_ROWS], "CAST(NULL AS INT)")


def _name(column: Column | str) -> str:
    """A column's SQL text; of a Column, only a plain name has one that can be relied on."""
    if isinstance(column, str):
        return column
    name = str(column)[len("Column<'"):-len("'>")]
    if not name.isidentifier():
        raise TypeError(f"give SQL text or a named column, not {column}")
    return name


def body_part(column: Column | str) -> Column:
    return F.expr(body_part_sql(_name(column)))


@cache
def nature_sql(column: str) -> str:
    """struct(no, fixed body part, whether the body part is looked up), as SQL.

    A first test handles facial/skull fractures and subungual hematomas; the rows then
    override it when one of them fits. "injury"/"trauma" alone sets only the body part.
    """
    def st(no, fixed, look):
        return (f"named_struct('no', CAST({'NULL' if no is None else no} AS INT), "
                f"'fixed', CAST({'NULL' if fixed is None else fixed} AS INT), 'look', {str(look).lower()})")

    first = [((has("facial", "skull") & has("fracture")).sql(column), (42, 135, False)),
             (has_all("subungual", "hematoma").sql(column), (10, None, True))]
    rows = [(cond.sql(column), st(code, None if b == LOOKUP else b, b == LOOKUP)) for code, cond, b in NATURE_ROWS]
    no = _case([(c, str(v[0])) for c, v in first], "NULL")
    rows.append((has("injury", "trauma").sql(column), st(no, None, True)))
    return _case(rows, _case([(c, st(*v)) for c, v in first], st(None, None, False)))


def nature_and_body(column: Column | str, bp: Column | str) -> Column:
    """struct(no, bp) for a lower-cased diagnosis column; ``bp`` is the body-part column. A
    tibia-and-fibula text always takes the looked-up body part. The chain is bound once (as the
    fold's start value) and read through a variable, so it is not copied into each field."""
    column, bp = _name(column), _name(bp)
    tibia = has_all("tibia", "fibula").sql(column)
    return F.expr(f"""aggregate(array(0), {nature_sql(column)}, (acc, x) -> acc, m -> named_struct(
        'no', m.no, 'bp', CAST(CASE WHEN coalesce(m.look OR {tibia}, false) THEN {bp} ELSE m.fixed END AS INT)))""")


def disposition_code(remark: Column, disposition: Column, no1: Column, bp1: Column) -> Column:
    """Left without being seen → 1; admitted/transferred → 8 for a mental-health nature
    (71/900), else 7; deceased → 9; a consult in the visit remark → 6; else null."""
    return (F.when(disposition.isin(DISP_LEFT), F.lit(1))
            .when(disposition.isin(DISP_ADMITTED),
                  F.when((no1 == 71) & (bp1 == 900), F.lit(8)).otherwise(F.lit(7)))
            .when(disposition == "Deceased", F.lit(9))
            .when(remark.contains("consult") | F.lower(remark).contains("consult follow up"), F.lit(6))
            .otherwise(F.lit(None).cast("int")))


def pin(df, **exprs):
    """Add computed columns evaluated exactly once per row.

    The columns come out of a one-row ``inline`` (a Generate node), which later
    projections cannot be merged through; without it, every later reference to a
    large rule expression would be expanded into another copy of that expression.
    """
    row = F.struct(*[e.alias(f"__pin_{k}") for k, e in exprs.items()])
    out = df.select("*", F.inline(F.array(row)))
    out = out.drop(*[k for k in exprs if k in df.columns])
    return out.withColumnsRenamed({f"__pin_{k}": k for k in exprs})
