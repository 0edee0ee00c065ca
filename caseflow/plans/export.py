"""Raw export by date window or key list: every stored row of the selected encounters,
fan-out of referrals × notes kept, in the export layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators import filters as flt
from caseflow.operators.aggregates import problem_list


def raw_export(tables: dict[str, DataFrame], keys: DataFrame | None = None, start=None, end=None) -> DataFrame:
    enc = flt.select_encounters(tables["encounters"], "arrival_ts", keys, start, end)
    sel = enc.select("encounter_id")
    refs = tables["referrals"].join(sel, "encounter_id", "left_semi")
    notes = tables["notes"].join(sel, "encounter_id", "left_semi").select(
        "encounter_id", "note_type", "author_type", "author_service", "note_text")
    plist = problem_list(tables["problems"].join(sel, "encounter_id", "left_semi"))
    out = (enc.join(tables["subjects"].select("subject_id", "dob"), "subject_id", "left")
           .join(refs, "encounter_id", "left")
           .join(notes, "encounter_id", "left")
           .join(plist, "encounter_id", "left"))
    return out.select("encounter_id", "subject_id", "sex", "dob", "age", "postal_code", "arrival_date", "arrival_time",
                      "los", "chief_complaint", "problem_list", "diagnosis", "ctas", "referral", "note_type",
                      "author_type", "author_service", "note_text", "address", "city", "province", "disposition",
                      F.lit(1).alias("line"), F.lit(None).cast("string").alias("icon"),
                      F.lit(None).cast("string").alias("subject_name"))
