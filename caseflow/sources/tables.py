"""The engine's stored tables, as typed DataFrames.

In production these are parquet tables under one root (``read_stored``). For
the driver data, the same shapes are derived from the stand-in roles in
``caseflow.fixtures`` (``stored_*``), so every job reads real driver rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.functions import fields as ff
from caseflow.operators.versions import latest_version
from caseflow.session import prepare
from caseflow.sources.schemas import STORED, read_declared, schema_of
from caseflow.sources.sinks import table_exists

def read_stored(spark: SparkSession, root: str, names: list[str] | None = None, every_file: bool = False) -> dict[str, DataFrame]:
    """The stored tables under ``root`` by name, under their declared schemas and as temp views. A table
    that nothing was written to yet has no rows; a root that does not exist is an error."""
    prepare(spark)
    if not table_exists(spark, root):
        raise ValueError(f"nothing is stored at {root}")
    out = {}
    for n in names or list(STORED):
        out[n] = read_declared(spark, f"{root}/{n}", schema_of(n), every_file)
        out[n].createOrReplaceTempView(n)
    return out


def stored_subjects(spark, d) -> DataFrame:
    s = fx.subjects_src(spark, d)
    return s.select("subject_id", ff.scramble_id("subject_id").alias("scrambled_id"), "dob")


def stored_encounters(spark, d) -> DataFrame:
    """Typed encounter facts: the visit stand-in with the encounter-build field rules."""
    v = fx.visits_src(spark, d)
    s = fx.subjects_src(spark, d).select("subject_id", "dob")
    return (v.join(s, "subject_id", "left").select(
        "encounter_id", "subject_id", "arrival_ts", "arrival_date",
        ff.normalise_sex("sex_raw").alias("sex"),
        ff.age_years("arrival_date", "dob").alias("age"),
        ff.weekday_name("arrival_date").alias("day_of_week"),
        F.date_format("arrival_ts", "HH:mm:ss").alias("arrival_time"),
        ff.triage_level("ctas_raw").alias("ctas"),
        "chief_complaint", "diagnosis", "disposition", "los", "score", "postal_code", "address", "city", "province",
        # stand-ins for the narrative and the remark that the encounter build writes
        F.concat_ws(": ", "chief_complaint", "diagnosis").alias("full_narrative"),
        F.lower("disposition").alias("notes")))


def stored_cases(spark, d) -> DataFrame:
    return fx.case_versions_src(spark, d)


def latest_cases(spark, d) -> DataFrame:
    """The latest stored versions; the columns are derived after the choice, so that few are shuffled."""
    return fx.case_columns(latest_version(fx.case_rows_src(spark, d), "l_orderkey", "l_linenumber"))


def stored_summaries(spark, d) -> DataFrame:
    return fx.summaries_src(spark, d)


def latest_summaries(spark, d) -> DataFrame:
    return latest_version(fx.summaries_src(spark, d))


def stored_problems(spark, d) -> DataFrame:
    return fx.problems_src(spark, d)


def stored_referrals(spark, d) -> DataFrame:
    return fx.referrals_src(spark, d)


# Oracle side of the same typed stand-ins.
ENCOUNTERS_SQL = f"""SELECT v.encounter_id, v.subject_id, v.arrival_ts, v.arrival_date,
  CASE WHEN lower(v.sex_raw) = 'male' THEN 'M' WHEN lower(v.sex_raw) = 'female' THEN 'F' ELSE v.sex_raw END AS sex,
  CAST(floor(datediff('day', s.dob, v.arrival_date) / 365) AS INTEGER) AS age,
  dayname(v.arrival_date) AS day_of_week,
  strftime(v.arrival_ts, '%H:%M:%S') AS arrival_time,
  CASE WHEN regexp_matches(trim(v.ctas_raw), '^-?[0-9]+$') THEN CAST(trim(v.ctas_raw) AS INTEGER) END AS ctas,
  v.chief_complaint, v.diagnosis, v.disposition, v.los, v.score, v.postal_code, v.address, v.city, v.province,
  concat_ws(': ', v.chief_complaint, v.diagnosis) AS full_narrative, lower(v.disposition) AS notes
FROM ({fx.VISITS_SQL}) v LEFT JOIN ({fx.SUBJECTS_SQL}) s ON v.subject_id = s.subject_id"""

SUBJECTS_STORED_SQL = f"""SELECT subject_id,
  substr(CAST(subject_id AS VARCHAR), 1, length(CAST(subject_id AS VARCHAR)) - 2)
   || right(CAST(subject_id AS VARCHAR), 1) || substr(CAST(subject_id AS VARCHAR), length(CAST(subject_id AS VARCHAR)) - 1, 1)
   || CAST((CAST(right(CAST(subject_id AS VARCHAR), 1) AS INTEGER)
          + CAST(substr(CAST(subject_id AS VARCHAR), length(CAST(subject_id AS VARCHAR)) - 1, 1) AS INTEGER)) % 10 AS VARCHAR)
   AS scrambled_id, dob
FROM ({fx.SUBJECTS_SQL}) x"""
