"""Normalised tables built from one batch: subjects, encounters, problems, referrals,
summaries, processed notes; orphan pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import fields as ff
from caseflow.plans import notes as nt

KEY = "encounter_id"


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """Keep the first row per key under an explicit total order (never "first seen").

    ``order`` lists ascending sort expressions. A ``min_by`` hash aggregate with
    map-side partial aggregation: a key holding a third of all rows still sends one
    row per task to the shuffle, unlike a window that sorts the whole key in one task.
    """
    others = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*order)).alias("_first")
    return df.groupBy(key).agg(best).select(key, "_first.*")


def build_subjects(visits: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct subjects of the batch with their birth date and scrambled id, one row each."""
    s = visits.select("subject_id").distinct().join(subjects.select("subject_id", "dob"), "subject_id", "inner")
    s = first_per_key(s, "subject_id", [F.col("dob").isNull(), F.col("dob")])
    return s.select("subject_id", ff.scramble_id("subject_id").alias("scrambled_id"), "dob")


def build_encounters(visits: DataFrame, subjects: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per encounter that has note text: typed visit fields, age, weekday, the
    full narrative, the visit remark and the score."""
    have_text = lines.where(F.col("note_text").isNotNull()).select(KEY).distinct()
    v = visits.join(have_text, KEY, "left_semi")
    v = first_per_key(v, KEY, [F.col("arrival_ts"), F.col("subject_id")])
    v = v.join(subjects.select("subject_id", "dob"), "subject_id", "left")
    nar = nt.full_narratives(lines)
    rem = nt.visit_remarks(lines, visits)
    return (v.join(nar, KEY, "inner").join(rem, KEY, "inner")
            .select(KEY, "subject_id", ff.normalise_sex("sex_raw").alias("sex"),
                    ff.age_years("arrival_date", "dob").alias("age"), "arrival_date",
                    F.date_format("arrival_ts", "HH:mm:ss").alias("arrival_time"),
                    ff.weekday_name("arrival_date").alias("day_of_week"),
                    "full_narrative", F.col("remark").alias("notes"), "postal_code", "address", "city", "province",
                    "chief_complaint", "diagnosis", "disposition", ff.triage_level("ctas_raw").alias("ctas"), "los", "score"))


def build_problems(problem_lists: DataFrame, col: str = "problem_list") -> DataFrame:
    """Comma-separated problem lists → one row per problem: drop " ", strip one leading
    blank, drop empty strings; distinct per encounter."""
    p = problem_lists.where(F.col(col).isNotNull()).select(KEY, F.explode(F.split(col, ",")).alias("problem"))
    p = p.where(F.col("problem") != " ").withColumn("problem", F.regexp_replace("problem", "^ ", ""))
    return p.where(F.col("problem") != "").distinct()


def build_referrals(referrals: DataFrame) -> DataFrame:
    return (referrals.where(F.col("referral").isNotNull() & (F.col("referral") != ""))
            .select(KEY, "referral").distinct())


def build_summaries(parsed: DataFrame) -> DataFrame:
    return parsed.select(KEY, "summary_text", F.lit(1).alias("version"))


def prune_orphans(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Referential pruning: encounters need a subject; child tables need an encounter.
    Semi joins only (no row multiplication)."""
    out = dict(tables)
    out["encounters"] = tables["encounters"].join(tables["subjects"].select("subject_id"), "subject_id", "left_semi")
    enc_keys = out["encounters"].select(KEY)
    for name in ("referrals", "problems", "notes", "summaries", "processed_notes", "case_report"):
        if name in tables:
            out[name] = tables[name].join(enc_keys, KEY, "left_semi")
    if "chunked_notes" in tables and "notes" in out:
        out["chunked_notes"] = tables["chunked_notes"].join(out["notes"].select("note_id"), "note_id", "left_semi")
    return out
