"""Structured filters (F1–F17, F22) over the stored stand-ins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.catalog import register
from caseflow.catalog.report import stored
from caseflow.operators import filters as flt
from caseflow.operators.versions import latest_version
from caseflow.rules.codes import GROUP_OF, code_rows
from caseflow.rules.vocab import MERGE_NOTE_TYPES
from caseflow.sources import tables as tb

ENC = dict(encounters=tb.ENCOUNTERS_SQL)
OUT = ["encounter_id", "subject_id", "arrival_date", "sex", "age", "ctas", "los", "chief_complaint",
       "diagnosis", "postal_code"]
OUT_SQL = ", ".join(OUT)


def _enc(spark, d):
    return tb.stored_encounters(spark, d)


def _one(key: str, spec: dict, sql_where: str):
    @register(key, fx.with_views(f"SELECT {OUT_SQL} FROM encounters WHERE {sql_where}", **ENC))
    def q(spark, d):
        return flt.apply_table_filter(_enc(spark, d), spec).select(*OUT)
    return q


_one("filter_gt", {"los": {"gt": 12.0}}, "los > 12.0")
_one("filter_lt", {"age": {"lt": 5}}, "age < 5")
_one("filter_gte", {"ctas": {"gte": 4}}, "ctas >= 4")
_one("filter_lte", {"arrival_date": {"lte": dt.date(1995, 6, 30)}},
     "arrival_date <= DATE '1995-06-30'")
_one("filter_eq", {"sex": {"eq": "M"}}, "sex = 'M'")
_one("filter_neq", {"postal_code": {"neq": "K1A 0B1"}}, "postal_code <> 'K1A 0B1'")
_one("filter_in", {"chief_complaint": {"in": ["Burn", "Head Injury", "Cough"]}},
     "chief_complaint IN ('Burn', 'Head Injury', 'Cough')")
_one("filter_not_in", {"postal_code": {"not_in": ["M5V2T6", "H2X 1Y4"]}},
     "postal_code NOT IN ('M5V2T6', 'H2X 1Y4')")
_one("filter_like", {"diagnosis": {"like": "FRACTURE"}}, "contains(lower(diagnosis), 'fracture')")
_one("filter_not_like", {"diagnosis": {"not_like": "Injury"}}, "NOT contains(lower(diagnosis), 'injury')")
# Unknown operator and unknown column are skipped; the rest is a conjunction.
_one("filter_conjunction",
     {"age": {"gte": 10, "lt": 30, "between": 3}, "sex": {"eq": "F"}, "no_such_column": {"eq": 1},
      "ctas": {"neq": 1}},
     "age >= 10 AND age < 30 AND sex = 'F' AND ctas <> 1")


@register("filter_note_types", fx.with_views(
    "SELECT encounter_id, note_id, line, note_type FROM lines WHERE note_type IN ('ED Provider Notes', 'ED Triage Notes')",
    lines=fx.NOTE_LINES_SQL))
def filter_note_types(spark, d):
    return (fx.note_lines_src(spark, d).where(F.col("note_type").isin(MERGE_NOTE_TYPES))
            .select("encounter_id", "note_id", "line", "note_type"))


@register("filter_date_range", fx.with_views(
    "SELECT encounter_id, arrival_date FROM encounters WHERE arrival_date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'",
    **ENC))
def filter_date_range(spark, d):
    return flt.date_window(_enc(spark, d), "arrival_ts", "1997-03-01", "1997-06-30").select(
        "encounter_id", "arrival_date")


@register("filter_key_list", fx.with_views(
    "SELECT encounter_id, subject_id FROM encounters WHERE encounter_id IN (SELECT encounter_id FROM cases)",
    cases=fx.CASE_VERSIONS_SQL, **ENC))
def filter_key_list(spark, d):
    keys = tb.stored_cases(spark, d).select("encounter_id")
    return flt.select_encounters(_enc(spark, d), "arrival_ts", keys=keys).select("encounter_id", "subject_id")


MULTI = {"encounters": {"age": {"gte": 12}, "ctas": {"in": [1, 2]}},
         "problems": {"problem": {"like": "ring"}},
         "no_such_table": {"x": {"eq": 1}},
         "case_report": {"no1": {"in": [10, 11, 12]}}}


@register("filter_multi_table", fx.with_views("""
SELECT encounter_id FROM encounters WHERE age >= 12 AND ctas IN (1, 2)
INTERSECT SELECT encounter_id FROM problems WHERE contains(lower(problem), 'ring')
INTERSECT SELECT encounter_id FROM cases WHERE no1 IN (10, 11, 12)""",
    problems=fx.PROBLEMS_SQL, cases=fx.CASE_VERSIONS_SQL, **ENC))
def filter_multi_table(spark, d):
    t = stored(spark, d)
    return flt.filter_key_sets(t, MULTI)


@register("filter_cases_only", fx.with_views("""
SELECT DISTINCT encounter_id FROM encounters WHERE age >= 12 AND ctas IN (1, 2)
  AND encounter_id IN (SELECT encounter_id FROM cases)""", cases=fx.CASE_VERSIONS_SQL, **ENC))
def filter_cases_only(spark, d):
    t = stored(spark, d)
    return flt.filter_key_sets(t, {"encounters": MULTI["encounters"]}, restrict_to=t["case_report"])


def _any_sql(columns: list[str], codes: str) -> str:
    return "(" + " OR ".join(f"coalesce({c} IN ({codes}), false)" for c in columns) + ")"


@register("filter_virtual_group", fx.with_views(f"""
SELECT encounter_id, sd1, sd5, no1, no3, bp1, bp2 FROM (
  SELECT * FROM cases c WHERE version = (SELECT max(version) FROM cases c2 WHERE c2.encounter_id = c.encounter_id)) cur
WHERE {_any_sql(['sd1', 'sd2', 'sd3', 'sd4', 'sd5'], '2, 6')} AND NOT {_any_sql(['no1', 'no2', 'no3'], '12, 13')}
  AND {_any_sql(['bp1', 'bp2', 'bp3'], '110, 120, 530')}""", cases=fx.CASE_VERSIONS_SQL))
def filter_virtual_group(spark, d):
    cur = latest_version(tb.stored_cases(spark, d))
    spec = {"sd_all": {"in": [2, 6]}, "no_all": {"not_in": [12, 13]}, "bp_all": {"in": [110, 120, 530]}}
    return flt.apply_table_filter(cur, spec).select("encounter_id", "sd1", "sd5", "no1", "no3", "bp1", "bp2")


DECODE_COLS = ["intent", "am_pm", "i_o", "location", "area", "no1", "bp1", "no2", "bp2", "no3", "bp3", "sd1", "sd2", "sd3", "sd4",
               "sd5", "sports_code", "sub", "disp"]


def _code_dim_sql() -> str:
    rows = ", ".join("('{}', '{}', '{}')".format(c, k, v.replace("'", "''")) for c, k, v in code_rows())
    return f"SELECT * FROM (VALUES {rows}) t(code_column, code, label)"


@register("decode_labels", fx.with_views(f"""
SELECT u.encounter_id, u.code_column, u.code, d.label FROM (
  {' UNION ALL '.join(f"SELECT encounter_id, '{c}' AS code_column, '{GROUP_OF.get(c, c)}' AS grp, CAST({c} AS VARCHAR) AS code FROM cur" for c in DECODE_COLS)}) u
LEFT JOIN dim d ON d.code_column = u.grp AND d.code = u.code""",
    cases=fx.CASE_VERSIONS_SQL,
    cur="SELECT * FROM cases c WHERE version = (SELECT max(version) FROM cases c2 WHERE c2.encounter_id = c.encounter_id)",
    dim=_code_dim_sql()))
def decode_labels(spark, d):
    from caseflow.operators.decode import decode_codes
    cur = latest_version(tb.stored_cases(spark, d))
    return decode_codes(spark, cur, DECODE_COLS, group_of=GROUP_OF)
