"""Declared schemas of the stored tables, and the read that holds a table against them.

A column that the stored files do not have (added later) is null. A column stored under another type is
refused with its name, unless the stored type is a narrower number. Columns that are not declared are
not read. ``arrival_part`` is a folder name and always a string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from caseflow.sources.sinks import table_exists

PART = "arrival_part"

STORED = {
    "subjects": "subject_id long, scrambled_id string, dob date",
    "encounters": "encounter_id long, subject_id long, sex string, age int, arrival_date date, arrival_time string, "
                  "day_of_week string, full_narrative string, notes string, postal_code string, address string, city string, "
                  "province string, chief_complaint string, diagnosis string, disposition string, ctas int, los double, "
                  "score double, arrival_ts timestamp, arrival_part string",
    "note_lines": "encounter_id long, note_id long, note_type string, author_type string, author_service string, line int, "
                  "note_text string, copies long, line_hash long, arrival_part string",
    "notes": "encounter_id long, note_id long, note_type string, author_type string, author_service string, note_text string, "
             "arrival_part string",
    "chunked_notes": "note_id long, chunk_number int, chunk_text string, n_tokens long, chunk_id string, vec array<float>, "
                     "arrival_part string",
    "processed_notes": "encounter_id long, note_text string, vec array<float>, arrival_part string",
    "problems": "encounter_id long, problem string, id string, arrival_part string",
    "referrals": "encounter_id long, referral string, id string, arrival_part string",
    "summaries": "encounter_id long, summary_text string, version int, vec array<float>",
    "case_report": "encounter_id long, intent int, sub int, sub_id string, i_o string, location int, area int, injury_date int, "
                   "injury_hour int, injury_min int, am_pm string, sports_code int, sd1 int, sd2 int, sd3 int, sd4 int, sd5 int, "
                   "veh int, veh_p string, place string, w4p int, no1 int, bp1 int, no2 int, bp2 int, no3 int, bp3 int, "
                   "disp int, version int",
}

# stored type → declared types that hold all its values
WIDER = {"tinyint": {"smallint", "int", "bigint"}, "smallint": {"int", "bigint"}, "int": {"bigint"}, "float": {"double"}}


def schema_of(name: str) -> StructType:
    if name not in STORED:
        raise ValueError(f"unknown table {name!r}; one of {sorted(STORED)}")
    return StructType.fromDDL(STORED[name])


def check_types(stored: StructType, declared: StructType, what: str) -> None:
    """Refuse a stored column whose type is neither the declared one nor a narrower one."""
    have = {f.name: f.dataType.simpleString() for f in stored if f.name != PART}
    bad = [f"{f.name} is stored as {have[f.name]}, declared as {f.dataType.simpleString()}" for f in declared
           if f.name in have and have[f.name] != f.dataType.simpleString()
           and f.dataType.simpleString() not in WIDER.get(have[f.name], ())]
    if bad:
        raise ValueError(f"{what}: " + "; ".join(bad))


def read_declared(spark: SparkSession, path: str, schema: StructType, every_file: bool = False) -> DataFrame:
    """The parquet table at ``path`` under ``schema``; without rows where nothing is stored yet.

    The types are held against the footer of one file, so opening a table costs the same at any size; a
    file of another type further on fails the task that reads its column. ``every_file`` looks at all
    footers first (a job over the files)."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    check_types(spark.read.option("mergeSchema", every_file).parquet(path).schema, schema, path)
    return spark.read.schema(schema).parquet(path)
