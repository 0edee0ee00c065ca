"""Two-part case report for a date window or a key set (non-cases and cases)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import fields as ff
from caseflow.operators import filters as flt
from caseflow.operators.aggregates import ordered_join, problem_list
from caseflow.operators.versions import latest_version

# Report layout: (source column, report column), in report order.
REPORT_COLUMNS = [
    ("encounter_id", "encounter_id"), ("subject_id", "subject_id"), ("scrambled_id", "scrambled_id"),
    ("dob", "dob"), ("sex", "sex"), ("age", "age"), ("postal", "postal"), ("arrival_time", "er_time"),
    ("arrival_date", "er_date"), ("day_of_week", "er_day"), ("injury_date", "injury_date"),
    ("injury_hour", "injury_hour"), ("injury_min", "injury_min"), ("am_pm", "am_pm"), ("i_o", "i_o"),
    ("location", "location"), ("area", "area"), ("place", "place"), ("diagnosis", "diagnosis"),
    ("full_narrative", "full_narrative"), ("summary_text", "summary_text"), ("w4p", "w4p"), ("no1", "no1"),
    ("bp1", "bp1"), ("no2", "no2"), ("bp2", "bp2"), ("no3", "no3"), ("bp3", "bp3"), ("veh", "veh"),
    ("veh_p", "veh_p"), ("notes", "notes"), ("los", "los"), ("disp", "disp"), ("intent", "intent"), ("sub", "sub"),
    ("sub_id", "sub_id"), ("sd1", "sd1"), ("sd2", "sd2"), ("sd3", "sd3"), ("sd4", "sd4"), ("sd5", "sd5"),
    ("sports_code", "sports_code"), ("e1", "e1"), ("e2", "e2"), ("e3", "e3"), ("e4", "e4"), ("ctas", "ctas"),
    ("chief_complaint", "chief_complaint"), ("problem_list", "problem_list"),
    # beyond the report's own layout
    ("disposition", "disposition"), ("score", "score"), ("case_version", "case_version"), ("is_case", "is_case"),
]
BLANK_COLUMNS = ["e1", "e2", "e3", "e4"]  # filled in by the reviewers' own systems


def assemble_report(enc: DataFrame, subjects: DataFrame, cases: DataFrame, problems: DataFrame,
                    summaries: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Join the selected encounters with their subject, latest case version, problem
    list and latest summary, then project to the report layout.

    Every child table is reduced to one row per encounter *before* its join
    (problem lists aggregated, versions collapsed by max_by), so the joins never
    fan out and each shuffle carries at most one row per key and side.
    """
    cur_cases = (latest_version(cases.join(enc.select("encounter_id"), "encounter_id", "left_semi"))
                 .withColumnRenamed("version", "case_version").drop("score"))
    plist = problem_list(problems.join(enc.select("encounter_id"), "encounter_id", "left_semi"))
    cur_sum = latest_version(summaries.join(enc.select("encounter_id"), "encounter_id", "left_semi")) \
        .select("encounter_id", "summary_text")
    out = (enc.join(subjects, "subject_id", "inner")
           .join(cur_cases.withColumn("is_case", F.lit(True)), "encounter_id", "left")
           .join(plist, "encounter_id", "left")
           .join(cur_sum, "encounter_id", "left")
           .withColumn("is_case", F.coalesce("is_case", F.lit(False)))
           .withColumn("postal", ff.truncate_postal("postal_code"))
           .withColumns({c: F.lit(None).cast("string") for c in BLANK_COLUMNS}))
    cols = [F.col(src).alias(dst) for src, dst in REPORT_COLUMNS]
    if history is not None:
        out = out.join(history, "subject_id", "left")
        cols.append(F.col("previous_visits"))
    return out.select(*cols)


def report_by_date(tables: dict[str, DataFrame], start, end, with_history: bool = False) -> DataFrame:
    enc = flt.date_window(tables["encounters"], "arrival_ts", start, end)
    hist = previous_visits(tables, start, subjects=enc.select("subject_id")) if with_history else None
    return assemble_report(enc, tables["subjects"], tables["case_report"], tables["problems"],
                           tables["summaries"], hist)


def report_by_keys(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    enc = flt.key_list(tables["encounters"], keys)
    return assemble_report(enc, tables["subjects"], tables["case_report"], tables["problems"],
                           tables["summaries"])


def split_report(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(non-cases, cases): the two parts of the report."""
    return report.where(~F.col("is_case")), report.where(F.col("is_case"))


def previous_visits(tables: dict[str, DataFrame], before, subjects: DataFrame | None = None) -> DataFrame:
    """Per subject, a digest of visits earlier than ``before``: ``subject:encounter\\nsummary``
    lines joined by newline, ordered by arrival then encounter. With ``subjects``, only
    those subjects' history is assembled (semi join before the aggregation)."""
    import datetime as dt
    b = before if isinstance(before, dt.date) else dt.date.fromisoformat(str(before))
    enc = tables["encounters"].where(F.col("arrival_ts") < F.lit(dt.datetime.combine(b, dt.time())))
    if subjects is not None:
        enc = enc.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    cur_sum = latest_version(tables["summaries"].join(enc.select("encounter_id"), "encounter_id", "left_semi"))
    line = F.concat(F.col("subject_id").cast("string"), F.lit(":"), F.col("encounter_id").cast("string"),
                    F.lit("\n"), F.col("summary_text"))
    return (enc.select("encounter_id", "subject_id", "arrival_ts")
            .join(cur_sum.select("encounter_id", "summary_text"), "encounter_id", "inner")
            .groupBy("subject_id")
            .agg(ordered_join([F.col("arrival_ts"), F.col("encounter_id")], line, "\n").alias("previous_visits")))
