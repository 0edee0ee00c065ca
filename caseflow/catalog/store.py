"""Normalised builds, pruning, versions, review round trip and sinks
(A8–A11, C6, C11–C15, J1, J4–J6, J11–J13, S6–S9, T3, W8, P4, P5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.catalog import register
from caseflow.catalog.coding import PARSED_SQL, REMARKS_SQL, RESPONSES_SQL, responses_src
from caseflow.catalog.report import REPORT_END, REPORT_START, _report_sql, stored
from caseflow.operators import cases as cs
from caseflow.operators import filters as flt
from caseflow.operators import versions as vs
from caseflow.operators.aggregates import ordered_join
from caseflow.plans import entities as en
from caseflow.plans import report as rp
from caseflow.sources import sinks as sk
from caseflow.sources import tables as tb

ENC = dict(encounters=tb.ENCOUNTERS_SQL)
CASES = dict(cases=fx.CASE_VERSIONS_SQL)
LATEST_CASES_SQL = "SELECT * FROM cases c WHERE version = (SELECT max(version) FROM cases c2 WHERE c2.encounter_id = c.encounter_id)"


@register("subjects_build", fx.with_views(f"""
SELECT s.subject_id, x.scrambled_id, s.dob FROM (SELECT DISTINCT subject_id FROM visits) v
JOIN subj s ON s.subject_id = v.subject_id JOIN stored_subj x ON x.subject_id = s.subject_id""",
    visits=fx.VISITS_SQL, subj=fx.SUBJECTS_SQL, stored_subj=tb.SUBJECTS_STORED_SQL))
def subjects_build(spark, d):
    return en.build_subjects(fx.visits_src(spark, d), fx.subjects_src(spark, d))


@register("encounters_build", fx.with_views("""
SELECT e.encounter_id, e.subject_id, e.sex, e.age, e.arrival_date, e.arrival_time, e.day_of_week, n.full_narrative,
       r.remark AS notes, e.postal_code, e.address, e.city, e.province, e.chief_complaint, e.diagnosis, e.disposition, e.ctas, e.los, e.score
FROM encounters e
JOIN (SELECT encounter_id, string_agg(note_type || chr(10) || chr(10) || note_text, chr(10) || chr(10)
             ORDER BY list_position(['ED Triage Notes', 'ED Provider Notes', 'PS Initial Consult', 'Consults',
               'Consult Follow Up', 'Admission', 'Discharge Summary', 'Progress Notes', 'Assessment & Plan Note',
               'ED Trauma Note', 'ED Trauma Notes', 'ED Procedure Note', 'Procedures', 'Op Note',
               'Transfer In / Advice Note'], note_type), line) AS full_narrative
      FROM lines WHERE note_text IS NOT NULL AND note_type IN ('ED Triage Notes', 'ED Provider Notes',
        'PS Initial Consult', 'Consults', 'Consult Follow Up', 'Admission', 'Discharge Summary', 'Progress Notes',
        'Assessment & Plan Note', 'ED Trauma Note', 'ED Trauma Notes', 'ED Procedure Note', 'Procedures', 'Op Note',
        'Transfer In / Advice Note')
      GROUP BY encounter_id) n ON n.encounter_id = e.encounter_id
JOIN remarks r ON r.encounter_id = e.encounter_id
WHERE e.encounter_id IN (SELECT encounter_id FROM lines WHERE note_text IS NOT NULL)""",
    **ENC, lines=fx.NOTE_LINES_SQL, remarks=REMARKS_SQL))
def encounters_build(spark, d):
    return en.build_encounters(fx.visits_src(spark, d), fx.subjects_src(spark, d), fx.note_lines_src(spark, d))


PLIST_SQL = """SELECT encounter_id, string_agg(problem, ', ' ORDER BY problem) AS problem_list
FROM problems GROUP BY encounter_id"""


@register("problems_build", fx.with_views("""
SELECT DISTINCT encounter_id, regexp_replace(p, '^ ', '') AS problem
FROM (SELECT encounter_id, unnest(string_split(problem_list, ',')) AS p FROM plist)
WHERE p <> ' ' AND regexp_replace(p, '^ ', '') <> ''""", problems=fx.PROBLEMS_SQL, plist=PLIST_SQL))
def problems_build(spark, d):
    pl = (fx.problems_src(spark, d).groupBy("encounter_id")
          .agg(ordered_join([], F.col("problem"), ", ").alias("problem_list")))
    return en.build_problems(pl)


@register("distinct_referrals", fx.with_views("""
SELECT DISTINCT encounter_id, referral FROM refs WHERE referral IS NOT NULL AND referral <> ''""",
    refs=fx.REFERRALS_SQL))
def distinct_referrals(spark, d):
    return en.build_referrals(fx.referrals_src(spark, d))


@register("summaries_build", fx.with_views("SELECT encounter_id, summary_text, 1 AS version FROM parsed",
                                           responses=RESPONSES_SQL, parsed=PARSED_SQL))
def summaries_build(spark, d):
    return en.build_summaries(cs.parse_responses(responses_src(spark, d)))


@register("dedupe_first", """
SELECT subject_id, encounter_id, arrival_ts FROM (
  SELECT o_custkey + 100000 AS subject_id, o_orderkey AS encounter_id, o_orderdate AS arrival_ts,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedupe_first(spark, d):
    v = fx.visits_src(spark, d).select("subject_id", "encounter_id", "arrival_ts")
    return en.first_per_key(v, "subject_id", [F.col("arrival_ts"), F.col("encounter_id")])


@register("join_encounter_subject", fx.with_views("""
SELECT e.encounter_id, e.subject_id, s.scrambled_id, e.age FROM encounters e JOIN subj s ON s.subject_id = e.subject_id""",
    **ENC, subj=tb.SUBJECTS_STORED_SQL))
def join_encounter_subject(spark, d):
    e = tb.stored_encounters(spark, d)
    return e.join(tb.stored_subjects(spark, d), "subject_id", "inner").select("encounter_id", "subject_id",
                                                                              "scrambled_id", "age")


@register("prune_orphans", fx.with_views("""
SELECT 'encounters' AS table_name, count(*) AS n_rows FROM encounters WHERE subject_id IN (SELECT subject_id FROM subj)
UNION ALL SELECT 'problems', count(*) FROM problems WHERE encounter_id IN (SELECT encounter_id FROM encounters WHERE subject_id IN (SELECT subject_id FROM subj))
UNION ALL SELECT 'referrals', count(*) FROM refs WHERE encounter_id IN (SELECT encounter_id FROM encounters WHERE subject_id IN (SELECT subject_id FROM subj))
UNION ALL SELECT 'summaries', count(*) FROM sums WHERE encounter_id IN (SELECT encounter_id FROM encounters WHERE subject_id IN (SELECT subject_id FROM subj))
UNION ALL SELECT 'case_report', count(*) FROM cases WHERE encounter_id IN (SELECT encounter_id FROM encounters WHERE subject_id IN (SELECT subject_id FROM subj))
UNION ALL SELECT 'notes', count(*) FROM notes WHERE encounter_id IN (SELECT encounter_id FROM encounters WHERE subject_id IN (SELECT subject_id FROM subj))""",
    **ENC, subj=fx.SUBJECTS_SQL, problems=fx.PROBLEMS_SQL, refs=fx.REFERRALS_SQL, sums=fx.SUMMARIES_SQL,
    notes=fx.NOTES_SQL, **CASES))
def prune_orphans(spark, d):
    t = stored(spark, d)
    t["notes"] = fx.notes_src(spark, d)
    t["subjects"] = fx.subjects_src(spark, d)
    p = en.prune_orphans(t)
    parts = [p[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n in ("encounters", "problems", "referrals", "summaries", "case_report", "notes")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# ---------------------------------------------------------------- versions and review
COMPARE = ["injury_date", "injury_hour", "injury_min", "am_pm", "i_o", "location", "area", "place", "w4p", "no1", "bp1",
           "no2", "bp2", "no3", "bp3", "disp", "intent", "veh", "veh_p", "sub", "sub_id", "sd1", "sd2", "sd3", "sd4", "sd5",
           "sports_code"]


@register("latest_case_version", fx.with_views(LATEST_CASES_SQL, **CASES))
def latest_case_version(spark, d):
    return vs.latest_version(tb.stored_cases(spark, d))


@register("max_version", fx.with_views("SELECT encounter_id, max(version) AS max_version FROM cases GROUP BY encounter_id",
                                       **CASES))
def max_version(spark, d):
    return vs.max_version(tb.stored_cases(spark, d))


FRESH = {"intent": 10, "no1": 27, "bp1": 120, "i_o": "I", "disp": 3, "am_pm": "p", "sports_code": 2}


def upload_src(spark, d):
    """Reviewed report: current versions with edits on rows whose disposition code is 3 or 4,
    plus reports for visits that have no stored case yet (triage level 1)."""
    cur = tb.latest_cases(spark, d)
    edited = cur.withColumn("intent", F.when(F.col("disp") == 3, F.lit(19)).otherwise(F.col("intent"))) \
        .withColumn("bp1", F.when(F.col("disp") == 3, F.lit(999)).otherwise(F.col("bp1"))) \
        .withColumn("veh_p", F.when(F.col("disp") != 4, F.col("veh_p")))
    enc = tb.stored_encounters(spark, d).where(F.col("ctas") == 1)
    fresh = (enc.join(fx.case_keys_src(spark, d).distinct(), "encounter_id", "left_anti")
             .select("encounter_id", *[F.lit(FRESH.get(c)).cast(edited.schema[c].dataType).alias(c) for c in COMPARE]))
    return edited.select("encounter_id", *COMPARE).unionByName(fresh)


def _edited_sql(c: str) -> str:
    return {"intent": "CASE WHEN disp = 3 THEN 19 ELSE intent END AS intent", "bp1": "CASE WHEN disp = 3 THEN 999 ELSE bp1 END AS bp1",
            "veh_p": "CASE WHEN disp = 4 THEN NULL ELSE veh_p END AS veh_p"}.get(c, c)


def _fresh_sql(c: str) -> str:
    v = FRESH.get(c)
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


UPLOAD_SQL = f"""SELECT encounter_id, {', '.join(map(_edited_sql, COMPARE))} FROM latest
UNION ALL
SELECT encounter_id, {', '.join(map(_fresh_sql, COMPARE))} FROM encounters
WHERE ctas = 1 AND encounter_id NOT IN (SELECT encounter_id FROM cases)"""
DIFFERS = " OR ".join(f"u.{c} IS DISTINCT FROM l.{c}" for c in COMPARE)
REVIEW_VIEWS = dict(**ENC, **CASES, latest=LATEST_CASES_SQL, upload=UPLOAD_SQL)


@register("diff_case_versions", fx.with_views("""
SELECT u.* FROM upload u JOIN latest l ON l.encounter_id = u.encounter_id
WHERE """ + DIFFERS, **REVIEW_VIEWS))
def diff_case_versions(spark, d):
    cur = tb.latest_cases(spark, d)
    return vs.changed_rows(cur, upload_src(spark, d), COMPARE)


@register("new_case_keys", fx.with_views(
    "SELECT DISTINCT encounter_id FROM upload WHERE encounter_id NOT IN (SELECT encounter_id FROM cases)", **REVIEW_VIEWS))
def new_case_keys(spark, d):
    return vs.new_rows(tb.stored_cases(spark, d), upload_src(spark, d)).select("encounter_id").distinct()


UPDATES_SQL = f"""
SELECT u.encounter_id, {', '.join('u.' + c for c in COMPARE)}, l.version + 1 AS version
FROM upload u JOIN latest l ON l.encounter_id = u.encounter_id WHERE {DIFFERS}
UNION ALL
SELECT encounter_id, {', '.join(COMPARE)}, 1 FROM upload WHERE encounter_id NOT IN (SELECT encounter_id FROM cases)"""


@register("apply_case_updates", fx.with_views(UPDATES_SQL, **REVIEW_VIEWS))
def apply_case_updates(spark, d):
    return vs.apply_updates(tb.stored_cases(spark, d), upload_src(spark, d), COMPARE)


@register("review_round_trip", fx.with_views(f"""
SELECT encounter_id, {', '.join(COMPARE)}, version FROM updates
UNION ALL
SELECT encounter_id, {', '.join(COMPARE)}, version FROM latest
WHERE encounter_id NOT IN (SELECT encounter_id FROM updates)""", **REVIEW_VIEWS, updates=UPDATES_SQL))
def review_round_trip(spark, d):
    """The stored table after a review: versions appended, read back, latest per visit."""
    from caseflow.session import scratch_path
    cols = ["encounter_id", *COMPARE, "version"]
    path = scratch_path(spark, "case_report")
    # a visit's versions lie in one file, as far as they are not too many: read back, they are reduced before the shuffle
    before = fx.case_columns(fx.case_rows_src(spark, d).hint("rebalance", F.col("l_orderkey"))).select(*cols)
    sk.append(before, path)
    stored_cases = spark.read.schema(before.schema).parquet(path)
    updates = vs.apply_updates(stored_cases, upload_src(spark, d), COMPARE)
    sk.append(updates.select(*[F.col(f.name).cast(f.dataType) for f in before.schema]), path)
    return vs.latest_version(spark.read.schema(before.schema).parquet(path))


def summary_upload(spark, d):
    doc = fx.read(spark, d, "documents")
    return doc.select(F.col("doc_id").alias("encounter_id"),
                      F.when(F.col("lang") == "de", F.concat("text", F.lit(" (reviewed)")))
                      .otherwise(F.col("text")).alias("summary_text"))


SUM_UPLOAD_SQL = "SELECT doc_id AS encounter_id, CASE WHEN lang = 'de' THEN text || ' (reviewed)' ELSE text END AS summary_text FROM documents"


@register("diff_summaries", fx.with_views("""
SELECT u.encounter_id, u.summary_text FROM up u LEFT JOIN sums s ON s.encounter_id = u.encounter_id
WHERE u.summary_text IS DISTINCT FROM s.summary_text""", up=SUM_UPLOAD_SQL, sums=fx.LATEST_SUMMARIES_SQL))
def diff_summaries(spark, d):
    cur = vs.latest_version(tb.stored_summaries(spark, d))
    return vs.changed_texts(cur, summary_upload(spark, d), "summary_text").select("encounter_id", "summary_text")


@register("apply_summary_updates", fx.with_views("""
SELECT u.encounter_id, u.summary_text, coalesce(m.mv, 0) + 1 AS version
FROM up u LEFT JOIN sums s ON s.encounter_id = u.encounter_id
LEFT JOIN (SELECT encounter_id, max(version) AS mv FROM sums GROUP BY encounter_id) m ON m.encounter_id = u.encounter_id
WHERE u.summary_text IS DISTINCT FROM s.summary_text""", up=SUM_UPLOAD_SQL, sums=fx.LATEST_SUMMARIES_SQL))
def apply_summary_updates(spark, d):
    st = tb.stored_summaries(spark, d)
    cur = vs.latest_version(st)
    ch = vs.changed_texts(cur, summary_upload(spark, d), "summary_text")
    mv = vs.max_version(st)
    return (ch.join(mv, "encounter_id", "left")
            .select("encounter_id", "summary_text",
                    (F.coalesce("max_version", F.lit(0)) + 1).cast("int").alias("version")))


@register("validate_report_upload", fx.with_views("SELECT *, 2 AS n_missing FROM upload WHERE encounter_id IS NOT NULL",
                                                  **REVIEW_VIEWS))
def validate_report_upload(spark, d):
    rows, missing = sk.validate_upload(upload_src(spark, d), ["encounter_id", *COMPARE, "e1", "chief_complaint"])
    return rows.withColumn("n_missing", F.lit(len(missing)))


# ---------------------------------------------------------------- sinks (write, read back)
STORE_BEFORE = dt.date(1998, 1, 1)
BATCH = ("1998-01-01", "1998-01-31")


def _store_and_batch(spark, d):
    e = tb.stored_encounters(spark, d)
    old = e.where(F.col("arrival_ts") < F.lit(dt.datetime.combine(STORE_BEFORE, dt.time())))
    batch = flt.date_window(e, "arrival_ts", *BATCH)
    return old, batch


@register("sink_new_subjects", fx.with_views(f"""
SELECT DISTINCT subject_id FROM encounters WHERE arrival_date BETWEEN DATE '{BATCH[0]}' AND DATE '{BATCH[1]}'
  AND subject_id NOT IN (SELECT subject_id FROM encounters WHERE arrival_date < DATE '{STORE_BEFORE}')""", **ENC))
def sink_new_subjects(spark, d):
    old, batch = _store_and_batch(spark, d)
    new = sk.new_keys(batch.select("subject_id").distinct(), old, "subject_id")
    return sk.roundtrip(spark, new, "new_subjects")


@register("sink_new_encounters", fx.with_views(f"""
SELECT encounter_id, subject_id FROM encounters WHERE arrival_date BETWEEN DATE '{BATCH[0]}' AND DATE '{BATCH[1]}'
  AND encounter_id NOT IN (SELECT encounter_id FROM encounters WHERE arrival_date < DATE '{STORE_BEFORE}')""", **ENC))
def sink_new_encounters(spark, d):
    old, batch = _store_and_batch(spark, d)
    new = sk.new_keys(batch.select("encounter_id", "subject_id"), old, "encounter_id")
    return sk.roundtrip(spark, new, "new_encounters")


@register("sink_append_children", fx.with_views(f"""
SELECT 'problems' AS table_name, count(*) AS n_rows FROM problems WHERE encounter_id IN (SELECT encounter_id FROM b)
UNION ALL SELECT 'referrals', count(*) FROM refs WHERE encounter_id IN (SELECT encounter_id FROM b)
UNION ALL SELECT 'summaries', count(*) FROM sums WHERE encounter_id IN (SELECT encounter_id FROM b)""",
    **ENC, b=f"SELECT encounter_id FROM encounters WHERE arrival_date BETWEEN DATE '{BATCH[0]}' AND DATE '{BATCH[1]}'",
    problems=fx.PROBLEMS_SQL, refs=fx.REFERRALS_SQL, sums=fx.SUMMARIES_SQL))
def sink_append_children(spark, d):
    from caseflow.session import scratch_path
    _, batch = _store_and_batch(spark, d)
    keys = batch.select("encounter_id")
    t = stored(spark, d)
    out = None
    for name, df in (("problems", t["problems"]), ("referrals", t["referrals"]), ("summaries", t["summaries"])):
        path = scratch_path(spark, f"append_{name}")
        sk.append(df.join(keys, "encounter_id", "left_semi"), path)
        back = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows")
        out = back if out is None else out.unionByName(back)
    return out


@register("sink_report_split", _report_sql(
    "SELECT is_case, count(*) AS n_rows FROM report GROUP BY is_case"))
def sink_report_split(spark, d):
    rep = rp.report_by_date(stored(spark, d), REPORT_START, REPORT_END)
    back = sk.roundtrip(spark, rep, "report_split", partition_by="is_case")
    return back.groupBy("is_case").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- raw export
@register("raw_export", fx.with_views("""
SELECT e.encounter_id, e.subject_id, e.sex, s.dob, e.age, e.postal_code, e.arrival_date, e.arrival_time, e.los,
       e.chief_complaint, p.problem_list, e.diagnosis, e.ctas, r.referral, n.note_type, n.author_type, n.author_service,
       n.note_text, e.address, e.city, e.province, e.disposition, 1 AS line, CAST(NULL AS VARCHAR) AS icon,
       CAST(NULL AS VARCHAR) AS subject_name
FROM encounters e
LEFT JOIN subj s ON s.subject_id = e.subject_id
LEFT JOIN refs r ON r.encounter_id = e.encounter_id
LEFT JOIN notes n ON n.encounter_id = e.encounter_id
LEFT JOIN (SELECT encounter_id, string_agg(problem, ',' ORDER BY problem) AS problem_list FROM problems
           GROUP BY encounter_id) p ON p.encounter_id = e.encounter_id
WHERE e.arrival_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'""",
    **ENC, subj=fx.SUBJECTS_SQL, refs=fx.REFERRALS_SQL, notes=fx.NOTES_SQL, problems=fx.PROBLEMS_SQL))
def raw_export(spark, d):
    from caseflow.plans.export import raw_export as rx
    t = stored(spark, d)
    t["notes"] = fx.notes_src(spark, d)
    t["subjects"] = fx.subjects_src(spark, d)
    return rx(t, start="1997-03-01", end="1997-03-31")
