"""Report queries (P2): by date window, with visit history, split in two parts."""

from __future__ import annotations

from caseflow import fixtures as fx
from caseflow.catalog import register
from caseflow.plans import report as rp
from caseflow.sources import tables as tb

REPORT_START, REPORT_END = "1998-01-01", "1998-12-31"


def stored(spark, d) -> dict:
    return {"encounters": tb.stored_encounters(spark, d), "subjects": tb.stored_subjects(spark, d),
            "case_report": tb.stored_cases(spark, d), "problems": tb.stored_problems(spark, d),
            "summaries": tb.stored_summaries(spark, d), "referrals": tb.stored_referrals(spark, d)}


REPORT_VIEWS = dict(encounters=tb.ENCOUNTERS_SQL, subjects=tb.SUBJECTS_STORED_SQL,
                    case_report=fx.CASE_VERSIONS_SQL, problems=fx.PROBLEMS_SQL, summaries=fx.SUMMARIES_SQL)

DATE_SEL = f"SELECT * FROM encounters WHERE arrival_date BETWEEN DATE '{REPORT_START}' AND DATE '{REPORT_END}'"

REPORT_SQL_BODY = """
, sel AS (__SEL__)
, cur_case AS (SELECT * FROM case_report c
               WHERE version = (SELECT max(version) FROM case_report c2 WHERE c2.encounter_id = c.encounter_id))
, plist AS (SELECT encounter_id, string_agg(problem, ',' ORDER BY problem) AS problem_list
            FROM problems WHERE problem IS NOT NULL GROUP BY encounter_id)
, cur_sum AS (SELECT s.encounter_id, s.summary_text FROM summaries s
              WHERE version = (SELECT max(version) FROM summaries s2 WHERE s2.encounter_id = s.encounter_id))
, report AS (
SELECT e.encounter_id, e.subject_id, j.scrambled_id, j.dob, e.sex, e.age,
  CASE WHEN length(e.postal_code) = 7 AND substr(e.postal_code, 4, 1) = ' ' THEN substr(e.postal_code, 1, 3)
       ELSE e.postal_code END AS postal,
  e.arrival_time AS er_time, e.arrival_date AS er_date, e.day_of_week AS er_day, c.injury_date, c.injury_hour,
  c.injury_min, c.am_pm, c.i_o, c.location, c.area, c.place, e.diagnosis, e.full_narrative, m.summary_text, c.w4p,
  c.no1, c.bp1, c.no2, c.bp2, c.no3, c.bp3, c.veh, c.veh_p, e.notes, e.los, c.disp, c.intent, c.sub, c.sub_id,
  c.sd1, c.sd2, c.sd3, c.sd4, c.sd5, c.sports_code, CAST(NULL AS VARCHAR) AS e1, CAST(NULL AS VARCHAR) AS e2,
  CAST(NULL AS VARCHAR) AS e3, CAST(NULL AS VARCHAR) AS e4, e.ctas, e.chief_complaint, p.problem_list,
  e.disposition, e.score, c.version AS case_version, c.encounter_id IS NOT NULL AS is_case
FROM sel e JOIN subjects j ON e.subject_id = j.subject_id
LEFT JOIN cur_case c ON c.encounter_id = e.encounter_id
LEFT JOIN plist p ON p.encounter_id = e.encounter_id
LEFT JOIN cur_sum m ON m.encounter_id = e.encounter_id)
"""


def _report_sql(select: str, sel: str = DATE_SEL, extra: str = "", **views) -> str:
    """Oracle report over the selected encounters ``sel``; ``extra`` adds CTEs (after the
    fixture views) that ``sel`` may use."""
    base = fx.with_views("SELECT 1", **REPORT_VIEWS, **views)
    head = base[: base.rindex("SELECT 1")].rstrip()
    return head + extra + REPORT_SQL_BODY.replace("__SEL__", sel) + select


@register("report_by_date", _report_sql("SELECT * FROM report"))
def report_by_date(spark, d):
    return rp.report_by_date(stored(spark, d), REPORT_START, REPORT_END)


@register("report_split_cases", _report_sql("SELECT * FROM report WHERE is_case"))
def report_split_cases(spark, d):
    return rp.split_report(rp.report_by_date(stored(spark, d), REPORT_START, REPORT_END))[1]


@register("report_split_noncases", _report_sql("SELECT * FROM report WHERE NOT is_case"))
def report_split_noncases(spark, d):
    return rp.split_report(rp.report_by_date(stored(spark, d), REPORT_START, REPORT_END))[0]


@register("report_with_history", _report_sql(f"""
, hist AS (
  SELECT e.subject_id, string_agg(CAST(e.subject_id AS VARCHAR) || ':' || CAST(e.encounter_id AS VARCHAR)
                                  || chr(10) || s.summary_text, chr(10) ORDER BY e.arrival_ts, e.encounter_id,
                                  CAST(e.subject_id AS VARCHAR) || ':' || CAST(e.encounter_id AS VARCHAR)
                                  || chr(10) || s.summary_text) AS previous_visits
  FROM encounters e JOIN cur_sum s ON s.encounter_id = e.encounter_id
  WHERE e.arrival_date < DATE '{REPORT_START}'
  GROUP BY e.subject_id)
SELECT r.*, h.previous_visits FROM report r LEFT JOIN hist h ON h.subject_id = r.subject_id"""))
def report_with_history(spark, d):
    return rp.report_by_date(stored(spark, d), REPORT_START, REPORT_END, with_history=True)


@register("previous_visits", fx.with_views(f"""
SELECT e.subject_id, string_agg(CAST(e.subject_id AS VARCHAR) || ':' || CAST(e.encounter_id AS VARCHAR)
        || chr(10) || s.summary_text, chr(10) ORDER BY e.arrival_ts, e.encounter_id) AS previous_visits
FROM encounters e JOIN summaries s ON s.encounter_id = e.encounter_id
WHERE e.arrival_date < DATE '{REPORT_START}'
GROUP BY e.subject_id""", encounters=tb.ENCOUNTERS_SQL, summaries=fx.LATEST_SUMMARIES_SQL))
def previous_visits(spark, d):
    return rp.previous_visits(stored(spark, d), REPORT_START)
