"""Coding jobs: body part, nature, disposition, case flag and cutoff, response parsing,
label decoding and the case-report build (A7, F17, F23, C16–C24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.catalog import register
from caseflow.catalog.expected_codes import values_sql
from caseflow.catalog.sqlfrag import sql_str_list
from caseflow.functions import coding as cd
from caseflow.functions import fields as ff
from caseflow.functions import responses as rs
from caseflow.operators import cases as cs
from caseflow.plans import notes as nt
from caseflow.rules.vocab import POSITIVE_COMPLAINTS
from caseflow.sources import tables as tb

ENC = dict(encounters=tb.ENCOUNTERS_SQL)
BATCH_START, BATCH_END = "1998-06-01", "1998-06-30"

# ---------------------------------------------------------------- fixture: model answers
SUMMARY_PHRASES = ["fell from the monkey bar at school", "slipped on snow outside", "fell in the washroom",
                   "bathroom fall at home", "pulled elbow", "tripped on laminate floor", "bike crash"]


def responses_src(spark, d):
    """(encounter_id, field, response): composed answer texts per encounter, some malformed."""
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    s = lambda v: F.lit(v)
    phrase = fx._pick(SUMMARY_PHRASES, k % len(SUMMARY_PHRASES))
    summary = F.when(k % 3 == 2, F.concat(s("summary: '"), phrase, s("'"))) \
        .otherwise(F.concat(s('{"summary": "'), phrase, s('"}')))
    substance = (F.when(k % 4 == 0, s('{"sub": 2,\n"sub_id": "N\\A"}'))
                 .when(k % 4 == 1, s('{"sub": 1,\n"sub_id": "alcohol"}'))
                 .when(k % 4 == 2, s("no substances")).otherwise(s('{"sub": 1}')))
    safety = (F.when(k % 3 == 0, s("{sd1: 2\nsd2: 6\nsd3: N\\A\nsd4: N\\A\nsd5: 9}"))
              .when(k % 3 == 1, s("{sd1: -1\nsd2: 3\nsd3: 3\nsd4: 3\nsd5: 3}")).otherwise(s("{sd1: 2}")))
    hour = F.when(k % 5 == 0, s("99")).otherwise(F.concat((k % 24).cast("string"), F.when(k % 2 == 0, s(".0"))
                                                        .otherwise(s(""))))
    minute = F.when(k % 7 == 0, s("99")).when(k % 7 == 1, s("30.0")).otherwise(F.lpad((k % 60).cast("string"), 2, "0"))
    time = F.when(k % 11 == 0, s("{time: unknown}")).otherwise(F.concat(s("{time: "), hour, s(":"), minute, s("}")))
    date = F.when(k % 6 == 0, s("{date: 99}")).when(k % 6 == 1, s("{date: x}")) \
        .otherwise(F.concat(s("{date: "), (k % 5).cast("string"), s("}")))
    fields = {
        "summary": summary, "substance": substance, "safety": safety,
        "io": F.concat(s('{"io": '), (k % 4).cast("string"), s("}")),
        "sports": F.concat(s("{sports: "), (k % 4 + 1).cast("string"), s("}")),
        "time": time, "date": date,
        "ampm": F.concat(s("{ampm: "), (k % 3).cast("string"), s("}")),
        "area": F.concat(s("{area: "), F.when(k % 9 == 0, s("0")).otherwise((k % 90 + 11).cast("string")), s("}")),
        "location": F.when(k % 13 == 0, s("location")).otherwise(
            F.concat(s("{location: "), (k % 140 + 11).cast("string"), s("}"))),
    }
    arr = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("response")) for f, v in fields.items()])
    return o.select(k.alias("encounter_id"), F.inline(arr))


def _sq(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


RESPONSES_SQL = f"""SELECT o_orderkey AS encounter_id, unnest(['summary', 'substance', 'safety', 'io', 'sports',
    'time', 'date', 'ampm', 'area', 'location']) AS field,
  unnest([
    CASE WHEN o_orderkey % 3 = 2 THEN 'summary: ''' || {sql_str_list(SUMMARY_PHRASES)}[CAST(o_orderkey % 7 AS INTEGER) + 1] || ''''
         ELSE '{{"summary": "' || {sql_str_list(SUMMARY_PHRASES)}[CAST(o_orderkey % 7 AS INTEGER) + 1] || '"}}' END,
    CASE o_orderkey % 4 WHEN 0 THEN '{{"sub": 2,' || chr(10) || '"sub_id": "N\\A"}}'
                         WHEN 1 THEN '{{"sub": 1,' || chr(10) || '"sub_id": "alcohol"}}'
                         WHEN 2 THEN 'no substances' ELSE '{{"sub": 1}}' END,
    CASE o_orderkey % 3 WHEN 0 THEN '{{sd1: 2' || chr(10) || 'sd2: 6' || chr(10) || 'sd3: N\\A' || chr(10) || 'sd4: N\\A' || chr(10) || 'sd5: 9}}'
                         WHEN 1 THEN '{{sd1: -1' || chr(10) || 'sd2: 3' || chr(10) || 'sd3: 3' || chr(10) || 'sd4: 3' || chr(10) || 'sd5: 3}}'
                         ELSE '{{sd1: 2}}' END,
    '{{"io": ' || CAST(o_orderkey % 4 AS VARCHAR) || '}}',
    '{{sports: ' || CAST(o_orderkey % 4 + 1 AS VARCHAR) || '}}',
    CASE WHEN o_orderkey % 11 = 0 THEN '{{time: unknown}}' ELSE '{{time: ' ||
      (CASE WHEN o_orderkey % 5 = 0 THEN '99' ELSE CAST(o_orderkey % 24 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END END)
      || ':' || (CASE WHEN o_orderkey % 7 = 0 THEN '99' WHEN o_orderkey % 7 = 1 THEN '30.0' ELSE lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END)
      || '}}' END,
    CASE WHEN o_orderkey % 6 = 0 THEN '{{date: 99}}' WHEN o_orderkey % 6 = 1 THEN '{{date: x}}'
         ELSE '{{date: ' || CAST(o_orderkey % 5 AS VARCHAR) || '}}' END,
    '{{ampm: ' || CAST(o_orderkey % 3 AS VARCHAR) || '}}',
    '{{area: ' || CASE WHEN o_orderkey % 9 = 0 THEN '0' ELSE CAST(o_orderkey % 90 + 11 AS VARCHAR) END || '}}',
    CASE WHEN o_orderkey % 13 = 0 THEN 'location' ELSE '{{location: ' || CAST(o_orderkey % 140 + 11 AS VARCHAR) || '}}' END
  ]) AS response
FROM orders"""

# Oracle parse of the answers, written from the field rules.
PARSED_SQL = """SELECT encounter_id,
  trim(CASE WHEN json_valid(r_summary) AND json_extract_string(r_summary, '$.summary') IS NOT NULL
            THEN json_extract_string(r_summary, '$.summary')
            ELSE regexp_replace(replace(r_summary, 'summary', ''), '[{}'':]', '', 'g') END) AS summary_text,
  CASE WHEN sub_ok THEN trim(replace(string_split(sl[1], ':')[2], ',', '')) END AS sub,
  CASE WHEN sub_ok AND trim(replace(string_split(sl[2], ':')[2], '}', '')) NOT IN ('N\\A', 'N/A')
       THEN trim(replace(string_split(sl[2], ':')[2], '}', '')) END AS sub_id,
  CASE WHEN sd_ok THEN trim(string_split(dl[1], ':')[2]) END AS sd1,
  CASE WHEN sd_ok AND trim(string_split(dl[1], ':')[2]) <> '-1' AND trim(string_split(dl[2], ':')[2]) NOT IN ('N\\A', 'N/A') THEN trim(string_split(dl[2], ':')[2]) END AS sd2,
  CASE WHEN sd_ok AND trim(string_split(dl[1], ':')[2]) <> '-1' AND trim(string_split(dl[3], ':')[2]) NOT IN ('N\\A', 'N/A') THEN trim(string_split(dl[3], ':')[2]) END AS sd3,
  CASE WHEN sd_ok AND trim(string_split(dl[1], ':')[2]) <> '-1' AND trim(string_split(dl[4], ':')[2]) NOT IN ('N\\A', 'N/A') THEN trim(string_split(dl[4], ':')[2]) END AS sd4,
  CASE WHEN sd_ok AND trim(string_split(dl[1], ':')[2]) <> '-1' AND trim(replace(string_split(dl[5], ':')[2], '}', '')) NOT IN ('N\\A', 'N/A') THEN trim(replace(string_split(dl[5], ':')[2], '}', '')) END AS sd5,
  trim(replace(string_split(r_io, ':')[2], '}', '')) AS i_o,
  trim(replace(string_split(r_sports, ':')[2], '}', '')) AS sports_code,
  CASE WHEN t_ok AND trim(replace(string_split(r_time, ':')[2], '.0', '')) <> '99' THEN trim(replace(string_split(r_time, ':')[2], '.0', '')) END AS injury_hour,
  CASE WHEN t_ok AND trim(regexp_replace(replace(string_split(r_time, ':')[3], '}', ''), '\\.0$', '')) <> '99'
       THEN trim(regexp_replace(replace(string_split(r_time, ':')[3], '}', ''), '\\.0$', '')) END AS injury_min,
  CASE WHEN regexp_matches(trim(replace(string_split(r_date, ':')[2], '}', '')), '^-?[0-9]+$')
        AND trim(replace(string_split(r_date, ':')[2], '}', '')) <> '99'
       THEN CAST(trim(replace(string_split(r_date, ':')[2], '}', '')) AS INTEGER) END AS injury_date,
  CASE WHEN trim(replace(string_split(r_ampm, ':')[2], '}', '')) <> '0' THEN trim(replace(string_split(r_ampm, ':')[2], '}', '')) END AS am_pm,
  CASE WHEN trim(replace(string_split(r_area, ':')[2], '}', '')) <> '0' THEN trim(replace(string_split(r_area, ':')[2], '}', '')) END AS area,
  CASE WHEN trim(replace(string_split(r_location, ':')[2], '}', '')) <> '0' THEN trim(replace(string_split(r_location, ':')[2], '}', '')) END AS location
FROM (SELECT *,
        string_split(coalesce(regexp_extract(r_substance, '\\{[^}]*\\}', 0), ''), chr(10)) AS sl,
        string_split(coalesce(regexp_extract(r_safety, '\\{[^}]*\\}', 0), ''), chr(10)) AS dl,
        string_split(coalesce(regexp_extract(r_substance, '\\{[^}]*\\}', 0), ''), chr(10))[1] IS NOT NULL
          AND string_split(string_split(coalesce(regexp_extract(r_substance, '\\{[^}]*\\}', 0), ''), chr(10))[1], ':')[2] IS NOT NULL
          AND string_split(string_split(coalesce(regexp_extract(r_substance, '\\{[^}]*\\}', 0), ''), chr(10))[2], ':')[2] IS NOT NULL AS sub_ok,
        list_bool_and([string_split(string_split(coalesce(regexp_extract(r_safety, '\\{[^}]*\\}', 0), ''), chr(10))[i], ':')[2] IS NOT NULL
                       FOR i IN [1, 2, 3, 4, 5]]) AS sd_ok,
        string_split(r_time, ':')[2] IS NOT NULL AND string_split(r_time, ':')[3] IS NOT NULL AS t_ok
      FROM (SELECT encounter_id,
              max(CASE WHEN field = 'summary' THEN response END) AS r_summary,
              max(CASE WHEN field = 'substance' THEN response END) AS r_substance,
              max(CASE WHEN field = 'safety' THEN response END) AS r_safety,
              max(CASE WHEN field = 'io' THEN response END) AS r_io,
              max(CASE WHEN field = 'sports' THEN response END) AS r_sports,
              max(CASE WHEN field = 'time' THEN response END) AS r_time,
              max(CASE WHEN field = 'date' THEN response END) AS r_date,
              max(CASE WHEN field = 'ampm' THEN response END) AS r_ampm,
              max(CASE WHEN field = 'area' THEN response END) AS r_area,
              max(CASE WHEN field = 'location' THEN response END) AS r_location
            FROM responses GROUP BY encounter_id) w) x"""


@register("parse_responses", fx.with_views("SELECT * FROM parsed", responses=RESPONSES_SQL, parsed=PARSED_SQL))
def parse_responses(spark, d):
    return cs.parse_responses(responses_src(spark, d))


# ---------------------------------------------------------------- diagnosis coding
@register("code_body_part", fx.with_views("""
SELECT e.encounter_id, x.bp AS body_part FROM encounters e LEFT JOIN expected x ON x.diagnosis = e.diagnosis""",
    expected=values_sql(), **ENC))
def code_body_part(spark, d):
    e = tb.stored_encounters(spark, d)
    return e.select("encounter_id", cd.body_part("lower(diagnosis)").alias("body_part"))


@register("code_nature", fx.with_views("""
SELECT e.encounter_id, x.no AS nature, x.nbp AS body_part FROM encounters e
LEFT JOIN expected x ON x.diagnosis = e.diagnosis""", expected=values_sql(), **ENC))
def code_nature(spark, d):
    e = tb.stored_encounters(spark, d).withColumn("_dx", F.lower(F.col("diagnosis")))
    e = cd.pin(e, _bp=cd.body_part(F.col("_dx")))
    e = cd.pin(e, _nb=cd.nature_and_body(F.col("_dx"), F.col("_bp")))
    return e.select("encounter_id", F.col("_nb.no").alias("nature"), F.col("_nb.bp").alias("body_part"))


REMARKS_SQL = f"""SELECT l.encounter_id,
  CASE WHEN lower(v.disposition) IN ('admit', 'deceased', 'lama', 'lwbr', 'lwbs', 'send to or', 'transfer to another facility') THEN lower(v.disposition)
       WHEN bool_or(contains(l.note_text, 'Consults') OR contains(l.note_text, 'Consult Follow Up')) THEN 'Consult'
       WHEN bool_or(l.note_type = 'ED Provider Notes') AND strpos(lower(string_agg(CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END, ' ' ORDER BY l.line)), 'assessment and plan') > 0
       THEN substr(string_agg(CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END, ' ' ORDER BY l.line),
                   strpos(lower(string_agg(CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END, ' ' ORDER BY l.line)), 'assessment and plan'))
       ELSE '' END AS remark
FROM lines l JOIN ({fx.VISITS_SQL}) v ON v.encounter_id = l.encounter_id GROUP BY l.encounter_id, v.disposition"""


@register("code_disposition", fx.with_views("""
SELECT e.encounter_id,
  CASE WHEN e.disposition IN ('LAMA', 'LBT2', 'LWBR', 'LWBS') THEN 1
       WHEN e.disposition IN ('Admit', 'Transfer to Another Facility', 'Send to OR', 'Send to Clinic')
         THEN CASE WHEN x.no = 71 AND x.nbp = 900 THEN 8 ELSE 7 END
       WHEN e.disposition = 'Deceased' THEN 9
       WHEN contains(coalesce(r.remark, ''), 'consult') OR contains(lower(coalesce(r.remark, '')), 'consult follow up') THEN 6
  END AS disp
FROM encounters e LEFT JOIN expected x ON x.diagnosis = e.diagnosis
LEFT JOIN remarks r ON r.encounter_id = e.encounter_id""",
    expected=values_sql(), lines=fx.NOTE_LINES_SQL, remarks=REMARKS_SQL, **ENC))
def code_disposition(spark, d):
    e = tb.stored_encounters(spark, d).withColumn("_dx", F.lower(F.col("diagnosis")))
    e = cd.pin(e, _bp=cd.body_part(F.col("_dx")))
    e = cd.pin(e, _nb=cd.nature_and_body(F.col("_dx"), F.col("_bp")))
    rem = nt.visit_remarks(fx.note_lines_src(spark, d), fx.visits_src(spark, d))
    e = e.join(rem, "encounter_id", "left")
    return e.select("encounter_id", cd.disposition_code(F.coalesce(F.col("remark"), F.lit("")), F.col("disposition"),
                                                        F.col("_nb.no"), F.col("_nb.bp")).alias("disp"))


# ---------------------------------------------------------------- flag and cutoff
POS_SQL = ", ".join(_sq(c) for c in POSITIVE_COMPLAINTS)
CUTOFF_SQL = f"""SELECT coalesce(min(score), 0.9) AS cutoff FROM encounters
WHERE arrival_date BETWEEN DATE '{BATCH_START}' - INTERVAL 30 DAY AND DATE '{BATCH_START}'
  AND chief_complaint IN ({POS_SQL})"""


@register("dynamic_cutoff", fx.with_views(CUTOFF_SQL, **ENC))
def dynamic_cutoff(spark, d):
    return cs.dynamic_cutoff(tb.stored_encounters(spark, d), BATCH_START)


FLAG_SQL = f"""SELECT e.encounter_id, e.score, e.chief_complaint,
  coalesce(e.score >= c.cutoff, false) OR e.chief_complaint IN ({POS_SQL}) AS is_case
FROM encounters e, cut c WHERE e.arrival_date BETWEEN DATE '{BATCH_START}' AND DATE '{BATCH_END}'"""


def _flagged(spark, d):
    from caseflow.operators import filters as flt
    e = tb.stored_encounters(spark, d)
    cutoff = cs.dynamic_cutoff(e, BATCH_START).scalar()
    batch = flt.date_window(e, "arrival_ts", BATCH_START, BATCH_END)
    return cs.flag_cases(batch, cutoff)


@register("flag_cases", fx.with_views(FLAG_SQL, **ENC, cut=CUTOFF_SQL))
def flag_cases(spark, d):
    return _flagged(spark, d).select("encounter_id", "score", "chief_complaint", "is_case")


# ---------------------------------------------------------------- labels and scores
INTENT_MAP = {0: 10, 1: 11, 2: 12, 3: 13, 4: 15, 5: 16, 6: 19}


def classifier_src(spark, d):
    """Stand-in classifier output per encounter: top label and its score."""
    o = fx.read(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("encounter_id"), F.concat(F.lit("LABEL_"), (k % 7).cast("string")).alias("label"),
                    (((k * 37) % 100) / 100.0).alias("label_score"))


CLASSIFIER_SQL = """SELECT o_orderkey AS encounter_id, 'LABEL_' || CAST(o_orderkey % 7 AS VARCHAR) AS label,
  CAST((o_orderkey * 37) % 100 AS DOUBLE) / 100.0 AS label_score FROM orders"""


@register("label_to_code", fx.with_views("""
SELECT encounter_id,
  CASE WHEN label_score >= 0.8 THEN [10, 11, 12, 13, 15, 16, 19][CAST(replace(label, 'LABEL_', '') AS INTEGER) + 1] END AS intent,
  round(CASE WHEN CAST(replace(label, 'LABEL_', '') AS INTEGER) = 0 THEN 1.0 - label_score ELSE label_score END, 6) AS p_positive
FROM cls""", cls=CLASSIFIER_SQL))
def label_to_code(spark, d):
    c = classifier_src(spark, d)
    idx = F.regexp_replace("label", "^LABEL_", "").cast("int")
    return c.select("encounter_id",
                    F.when(F.col("label_score") >= 0.8, rs.label_to_code(F.col("label"), INTENT_MAP)).alias("intent"),
                    F.round(rs.positive_probability(idx, F.col("label_score")), 6).alias("p_positive"))


REVIEWED_SQL = f"""SELECT encounter_id, diagnosis,
  [{", ".join(map(str, fx.INTENT_CODES))}][length(diagnosis) % {len(fx.INTENT_CODES)} + 1] AS intent FROM ({fx.VISITS_SQL}) v"""


def _reviewed(spark, d):
    """Stand-in for reviewed visits: the intent that a reviewer gave to each diagnosis text."""
    v = fx.visits_src(spark, d).select("encounter_id", "diagnosis")
    place = F.length("diagnosis") % len(fx.INTENT_CODES) + 1
    return v.withColumn("intent", F.element_at(F.array(*[F.lit(c) for c in fx.INTENT_CODES]), place))


@register("intent_from_text", f"SELECT encounter_id, intent FROM ({REVIEWED_SQL}) r")
def intent_from_text(spark, d):
    """The intent of every visit, read from its diagnosis by the seven-class model at its cutoff. The model
    learns from half of the visits (an even crc32 of the key), so what SQL states of the others is held out."""
    from caseflow.operators import scoring as so
    r = _reviewed(spark, d)
    model = so.fit_classes(r.where(F.crc32(F.col("encounter_id").cast("string")) % 2 == 0), "diagnosis", "intent", fx.INTENT_CODES)
    return so.predict_classes(model, r, "encounter_id", "diagnosis").select("encounter_id", "intent")


@register("ampm_from_hour", fx.with_views("""
SELECT encounter_id, CASE WHEN h >= 0 AND h < 12 THEN 1 WHEN h >= 12 AND h < 24 THEN 2 ELSE h END AS am_pm
FROM (SELECT encounter_id, TRY_CAST(injury_hour AS INTEGER) AS h FROM parsed)""",
    responses=RESPONSES_SQL, parsed=PARSED_SQL))
def ampm_from_hour(spark, d):
    p = cs.parse_responses(responses_src(spark, d))
    return p.select("encounter_id", ff.ampm_from_hour(F.col("injury_hour")).alias("am_pm"))


@register("coerce_codes", fx.with_views("""
SELECT encounter_id,
  CASE WHEN regexp_matches(trim(sd1), '^-?[0-9]+$') THEN CAST(trim(sd1) AS INTEGER) END AS sd1,
  CASE WHEN regexp_matches(trim(area), '^-?[0-9]+$') THEN CAST(trim(area) AS INTEGER) END AS area,
  CASE WHEN regexp_matches(trim(location), '^-?[0-9]+$') THEN CAST(trim(location) AS INTEGER) END AS location,
  CASE WHEN regexp_matches(trim(sports_code), '^-?[0-9]+$') THEN CAST(trim(sports_code) AS INTEGER) END AS sports_code,
  CASE WHEN regexp_matches(trim(sub), '^-?[0-9]+$') THEN CAST(trim(sub) AS INTEGER) END AS sub
FROM parsed""", responses=RESPONSES_SQL, parsed=PARSED_SQL))
def coerce_codes(spark, d):
    p = cs.parse_responses(responses_src(spark, d)).select("encounter_id", "sd1", "area", "location",
                                                            "sports_code", "sub")
    return cs.coerce_codes(p, ["sd1", "area", "location", "sports_code", "sub"])


@register("cases_defaults", fx.with_views(f"""
SELECT encounter_id, is_case, CAST(NULL AS VARCHAR) AS no1, CAST(NULL AS VARCHAR) AS place, 0 AS w4p FROM flagged""",
    **ENC, cut=CUTOFF_SQL, flagged=FLAG_SQL))
def cases_defaults(spark, d):
    f = _flagged(spark, d).select("encounter_id", "is_case")
    return cs.case_defaults(f).select("encounter_id", "is_case", "no1", "place", "w4p")


# ---------------------------------------------------------------- case build
def _intent_parsed(spark, d):
    p = cs.parse_responses(responses_src(spark, d))
    c = classifier_src(spark, d)
    intent = F.when(F.col("label_score") >= 0.8, rs.label_to_code(F.col("label"), INTENT_MAP))
    return p.join(c.select("encounter_id", intent.alias("intent")), "encounter_id", "left")


CASES_SQL = """
WITH b AS (
  SELECT f.encounter_id, e.chief_complaint, e.diagnosis, e.disposition, p.*, c.intent AS intent0, r.remark,
         x.no AS xno, x.nbp AS xbp
  FROM flagged f JOIN encounters e ON e.encounter_id = f.encounter_id
  LEFT JOIN parsed p ON p.encounter_id = f.encounter_id
  LEFT JOIN (SELECT encounter_id, CASE WHEN label_score >= 0.8
               THEN [10, 11, 12, 13, 15, 16, 19][CAST(replace(label, 'LABEL_', '') AS INTEGER) + 1] END AS intent FROM cls) c
    ON c.encounter_id = f.encounter_id
  LEFT JOIN remarks r ON r.encounter_id = f.encounter_id
  LEFT JOIN expected x ON x.diagnosis = e.diagnosis
  WHERE f.is_case),
s1 AS (SELECT *,
  CASE WHEN chief_complaint = 'Medical Device Problem' THEN 99 ELSE xno END AS n1,
  CASE WHEN chief_complaint = 'Medical Device Problem' THEN 999 ELSE xbp END AS b1 FROM b),
s2 AS (SELECT *,
  CASE WHEN disposition IN ('LAMA', 'LBT2', 'LWBR', 'LWBS') THEN 1
       WHEN disposition IN ('Admit', 'Transfer to Another Facility', 'Send to OR', 'Send to Clinic')
         THEN CASE WHEN n1 = 71 AND b1 = 900 THEN 8 ELSE 7 END
       WHEN disposition = 'Deceased' THEN 9
       WHEN contains(coalesce(remark, ''), 'consult') OR contains(lower(coalesce(remark, '')), 'consult follow up') THEN 6
  END AS dsp,
  coalesce(summary_text, '') AS st FROM s1),
s3 AS (SELECT *,
  CASE WHEN lower(st) = 'pulled elbow' THEN '3'
       WHEN contains(st, 'bathroom') THEN 'O' WHEN contains(st, 'washroom') THEN 'I'
       WHEN contains(st, 'snow') THEN 'O' WHEN contains(st, 'laminate floor') THEN 'I'
       WHEN trim(i_o) = '1' THEN 'I' WHEN trim(i_o) = '2' THEN 'O' END AS io1 FROM s2)
SELECT encounter_id,
  CASE WHEN (CASE WHEN dsp = 1 THEN 99 ELSE n1 END) = 71 THEN 16 ELSE intent0 END AS intent,
  CASE WHEN regexp_matches(trim(sub), '^-?[0-9]+$') THEN CAST(trim(sub) AS INTEGER) END AS sub, sub_id,
  CASE WHEN n1 = 71 THEN NULL ELSE io1 END AS i_o,
  CASE WHEN regexp_matches(trim(location), '^-?[0-9]+$') THEN CAST(trim(location) AS INTEGER) END AS location,
  CASE WHEN contains(st, 'monkey bar') THEN 59
       WHEN regexp_matches(trim(area), '^-?[0-9]+$') THEN CAST(trim(area) AS INTEGER) END AS area,
  injury_date,
  CASE WHEN regexp_matches(trim(injury_hour), '^-?[0-9]+$') THEN CAST(trim(injury_hour) AS INTEGER) END AS injury_hour,
  CASE WHEN regexp_matches(trim(replace(injury_min, '.', '')), '^-?[0-9]+$') THEN CAST(trim(replace(injury_min, '.', '')) AS INTEGER) END AS injury_min,
  CASE WHEN TRY_CAST(trim(injury_hour) AS INTEGER) BETWEEN 0 AND 11 THEN 'a'
       WHEN TRY_CAST(trim(injury_hour) AS INTEGER) BETWEEN 12 AND 23 THEN 'p'
       WHEN trim(am_pm) = '1' THEN 'a' WHEN trim(am_pm) = '2' THEN 'p' ELSE am_pm END AS am_pm,
  CASE WHEN regexp_matches(trim(sports_code), '^-?[0-9]+$') THEN CAST(trim(sports_code) AS INTEGER) END AS sports_code,
  CASE WHEN regexp_matches(trim(sd1), '^-?[0-9]+$') THEN CAST(trim(sd1) AS INTEGER) END AS sd1,
  CASE WHEN regexp_matches(trim(sd2), '^-?[0-9]+$') THEN CAST(trim(sd2) AS INTEGER) END AS sd2,
  CASE WHEN regexp_matches(trim(sd3), '^-?[0-9]+$') THEN CAST(trim(sd3) AS INTEGER) END AS sd3,
  CASE WHEN regexp_matches(trim(sd4), '^-?[0-9]+$') THEN CAST(trim(sd4) AS INTEGER) END AS sd4,
  CASE WHEN regexp_matches(trim(sd5), '^-?[0-9]+$') THEN CAST(trim(sd5) AS INTEGER) END AS sd5,
  CAST(NULL AS INTEGER) AS veh, CAST(NULL AS VARCHAR) AS veh_p, CAST(NULL AS VARCHAR) AS place, 0 AS w4p,
  CASE WHEN dsp = 1 THEN 99 ELSE n1 END AS no1,
  CASE WHEN dsp = 1 THEN 999 ELSE b1 END AS bp1,
  CASE WHEN contains(lower(coalesce(diagnosis, 'none')), 'monteggia') THEN 13
       WHEN n1 = 12 AND b1 = 110 THEN 41 END AS no2,
  CASE WHEN contains(lower(coalesce(diagnosis, 'none')), 'monteggia') THEN 430
       WHEN n1 = 12 AND b1 = 110 THEN 135 END AS bp2,
  CAST(NULL AS INTEGER) AS no3, CAST(NULL AS INTEGER) AS bp3,
  dsp AS disp, 1 AS version
FROM s3"""


@register("cases_build")
def cases_build(spark, d):
    flagged = _flagged(spark, d)
    enc = tb.stored_encounters(spark, d)
    rem = nt.visit_remarks(fx.note_lines_src(spark, d), fx.visits_src(spark, d))
    return cs.build_cases(flagged, _intent_parsed(spark, d), enc, rem)


def _cases_sql(flagged: str = FLAG_SQL) -> str:
    head = fx.with_views("SELECT 1", **ENC, cut=CUTOFF_SQL, flagged=flagged, responses=RESPONSES_SQL,
                         parsed=PARSED_SQL, cls=CLASSIFIER_SQL, lines=fx.NOTE_LINES_SQL, remarks=REMARKS_SQL,
                         expected=values_sql())
    head = head[: head.rindex("SELECT 1")].rstrip()
    return head + "\n" + CASES_SQL.replace("WITH b AS (", ", b AS (", 1)


from caseflow.catalog import ORACLE as _ORACLE  # noqa: E402

_ORACLE["cases_build"] = _cases_sql()
