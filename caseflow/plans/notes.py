"""Per-encounter note assembly: merged note lines, full narrative, visit remark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as tx
from caseflow.operators.aggregates import ordered_join
from caseflow.rules.vocab import MERGE_NOTE_TYPES, NARRATIVE_NOTE_ORDER, REMARK_DISPOSITIONS


def type_rank(col: str = "note_type", order: list[str] | None = None):
    """1-based position of the note type in the configured order; null if unlisted."""
    arr = F.array(*[F.lit(t) for t in (order or NARRATIVE_NOTE_ORDER)])
    pos = F.array_position(arr, F.col(col))
    return F.when(pos > 0, pos.cast("int"))


def merge_note_lines(lines: DataFrame, note_types: list[str] | None = None, expand: bool = True,
                     key: str = "encounter_id") -> DataFrame:
    """One text per encounter: the listed note types, ordered by (type, line), joined by
    a blank, whitespace collapsed, abbreviations expanded."""
    sel = lines.where(F.col("note_type").isin(note_types or MERGE_NOTE_TYPES))
    merged = sel.groupBy(key).agg(
        ordered_join([F.col("note_type"), F.col("line")], F.coalesce(F.col("note_text"), F.lit("None")), " ")
        .alias("_t"))
    text = tx.collapse_ws(F.col("_t"))
    if expand:
        text = tx.expand_terms(text)
    return merged.select(key, text.alias("note_text"))


def merge_note_ids(lines: DataFrame) -> DataFrame:
    """One row per note id: its distinct lines in line order joined by a blank, with the note's
    attributes. Lines without a note id (null, or no such column) are distinct rows of their own
    encounter, under a key derived from the row (negative, or "row-..." for text ids)."""
    row = ["encounter_id", "note_type", "author_type", "author_service", "note_text"]
    given = F.col("note_id") if "note_id" in lines.columns else F.lit(None).cast("long")
    values = F.to_json(F.struct(*row))
    if dict(lines.dtypes).get("note_id") == "string":
        derived = F.concat(F.lit("row-"), F.sha2(values, 256))
    else:
        derived = -F.xxhash64(values).bitwiseAND(F.lit((1 << 62) - 1)) - 1
    distinct = lines.select(F.coalesce(given, derived).alias("note_id"), *row,
                            F.when(given.isNotNull(), F.col("line")).alias("line")).distinct()
    return distinct.groupBy("note_id").agg(
        F.min("encounter_id").alias("encounter_id"), F.min("note_type").alias("note_type"),
        F.min("author_type").alias("author_type"), F.min("author_service").alias("author_service"),
        ordered_join([F.col("line")], F.coalesce(F.col("note_text"), F.lit("None")), " ").alias("note_text"))


def full_narratives(lines: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Per encounter: every listed note type in configured rank order (then line), each as
    ``type\\n\\ntext``, joined by a blank line; null texts are skipped."""
    ranked = lines.where(F.col("note_text").isNotNull()).withColumn("_rank", type_rank())
    piece = F.concat(F.col("note_type"), F.lit("\n\n"), F.col("note_text"))
    return (ranked.where(F.col("_rank").isNotNull()).groupBy(key)
            .agg(ordered_join([F.col("_rank"), F.col("line")], piece, "\n\n").alias("full_narrative")))


def visit_remarks(lines: DataFrame, visits: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Per encounter remark: the disposition if it is one of the listed ones; else
    "Consult" when a consult marker occurs in the notes; else the provider notes from
    "assessment and plan" on; else empty."""
    per = lines.groupBy(key).agg(
        F.bool_or(F.col("note_text").contains("Consults") | F.col("note_text").contains("Consult Follow Up"))
        .alias("_consult"),
        F.bool_or(F.col("note_type") == "ED Provider Notes").alias("_has_provider"),
        ordered_join([F.col("line")], F.when(F.col("note_type") == "ED Provider Notes",
                                             F.coalesce(F.col("note_text"), F.lit("None"))), " ").alias("_prov"))
    disp = F.lower(F.col("disposition"))
    idx = F.instr(F.lower(F.col("_prov")), "assessment and plan")
    remark = (F.when(disp.isin(REMARK_DISPOSITIONS), disp)
              .when(F.coalesce(F.col("_consult"), F.lit(False)), F.lit("Consult"))
              .when(F.coalesce(F.col("_has_provider"), F.lit(False)) & (idx > 0),
                    F.expr("substring(_prov, instr(lower(_prov), 'assessment and plan'))"))
              .otherwise(F.lit("")))
    return visits.select(key, "disposition").join(per, key, "inner").select(key, remark.alias("remark"))
