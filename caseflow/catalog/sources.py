"""Readers: note dump with surplus/short rows, typed lines, headered export (S1–S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.catalog import register
from caseflow.session import scratch_path
from caseflow.sources import note_dump as nd

DUMP_HEADER = "doc_id|lang|source|note_text"


def write_document_dump(spark, d) -> str:
    """A note dump made from ``documents``: one line per document (line breaks turned
    into blanks), texts keep their own ``|`` characters (surplus fields), and short
    rows are added for documents with no source. The header is its own file."""
    doc = fx.read(spark, d, "documents")
    path = scratch_path(spark, "note_dump")
    # the header file sorts first in the listing (0-header before 1-data)
    spark.createDataFrame([(DUMP_HEADER,)], "value string").coalesce(1).write.mode("overwrite") \
        .text(f"{path}/0-header")
    text = F.regexp_replace("text", "[\r\n]", " ")
    full = F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", text)
    short = F.concat_ws("|", F.col("doc_id").cast("string"), "lang")
    doc.select(F.when(F.col("lang") == "es", short).otherwise(full).alias("value")).write.mode("overwrite") \
        .text(f"{path}/1-data")
    return f"{path}/*"


@register("src_note_dump", r"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source,
  replace(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '[^\x00-\x7F]', '', 'g'), '\s+$', ''),
          '|', ' ') AS note_text
FROM documents WHERE lang <> 'es'""")
def src_note_dump(spark, d):
    rows, _ = nd.read_note_dump(spark, write_document_dump(spark, d), "doc_id")
    return rows


@register("src_note_dump_rejects", "SELECT CAST(doc_id AS VARCHAR) || '|' || lang AS line FROM documents WHERE lang = 'es'")
def src_note_dump_rejects(spark, d):
    _, rejects = nd.read_note_dump(spark, write_document_dump(spark, d), "doc_id")
    return rejects


@register("src_typed_lines", """
SELECT o_orderkey AS encounter_id, o_custkey AS subject_id,
  o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS arrival_ts,
  CAST((o_orderkey * 31) % 600 AS DOUBLE) * 60 / 3600.0 AS los,
  strftime(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)), '%H:%M:%S') AS arrival_time,
  CASE WHEN o_orderpriority LIKE '5%' THEN 0 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS ctas
FROM orders""")
def src_typed_lines(spark, d):
    """Dump-like string columns made from ``orders`` (arrival/departure times, blank
    triage level for the lowest priority), then typed."""
    o = fx.read(spark, d, "orders")
    arr = F.col("o_orderdate") + F.make_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    dep = arr + F.make_interval(mins=((F.col("o_orderkey") * 31) % 600).cast("int"))
    raw = o.select(
        F.col("o_orderkey").cast("string").alias("encounter_id"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.date_format(arr, "yyyy-MM-dd HH:mm:ss").alias("arrival_datetime"),
        F.date_format(dep, "yyyy-MM-dd HH:mm:ss").alias("departure_datetime"),
        F.when(F.col("o_orderpriority").startswith("5"), F.lit(" ")).otherwise(
            F.substring("o_orderpriority", 1, 1)).alias("ctas"))
    return nd.type_note_lines(raw)


def _write_export(spark, d) -> str:
    """An export with a title line above the header, made from ``benchmark``: whole texts as
    quoted fields, and for every fifth item a row with a surplus field."""
    b = fx.read(spark, d, "benchmark")
    path = scratch_path(spark, "export")
    spark.createDataFrame([("Weekly export",), ("item_id,text",)], "value string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    key = F.col("item_id").cast("string")
    text = F.regexp_replace(F.regexp_replace("text", "[\r\n]", " "), '"', '""')
    quoted = b.select(F.concat(key, F.lit(',"'), text, F.lit('"')).alias("value"))
    surplus = b.where(F.col("item_id") % 5 == 0).select(F.concat(key, F.lit(",one,two")).alias("value"))
    quoted.unionByName(surplus).write.mode("overwrite").text(f"{path}/1-data")
    return f"{path}/*"


@register("src_headered_export", r"""SELECT CAST(item_id AS VARCHAR) AS item_id,
  regexp_replace(text, '[\r\n]', ' ', 'g') AS text FROM benchmark""")
def src_headered_export(spark, d):
    return nd.read_headered_export(spark, _write_export(spark, d), "item_id")[0]


@register("src_headered_export_rejects",
          "SELECT CAST(item_id AS VARCHAR) || ',one,two' AS line FROM benchmark WHERE item_id % 5 = 0")
def src_headered_export_rejects(spark, d):
    return nd.read_headered_export(spark, _write_export(spark, d), "item_id")[1]


@register("src_notes_by_extension", """
SELECT 'parquet' AS format, CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n_chars FROM documents
UNION ALL SELECT 'export', CAST(item_id AS VARCHAR), length(regexp_replace(text, '[\r\n]', ' ', 'g')) FROM benchmark""")
def src_notes_by_extension(spark, d):
    """The reader chosen by the extension of the path, or stated."""
    docs, _ = nd.read_notes(spark, f"{d}/documents.parquet", "doc_id")
    items, _ = nd.read_notes(spark, _write_export(spark, d), "item_id", format="export")
    return (docs.select(F.lit("parquet").alias("format"), "doc_id", F.length("text").cast("long").alias("n_chars"))
            .unionByName(items.select(F.lit("export").alias("format"), F.col("item_id").alias("doc_id"),
                                      F.length("text").cast("long").alias("n_chars"))))


@register("stored_declared_read", f"""
SELECT encounter_id, version, intent, CASE WHEN version > 2 THEN sports_code END AS sports_code, CAST(NULL AS INTEGER) AS injury_hour
FROM ({fx.CASE_VERSIONS_SQL}) c""")
def stored_declared_read(spark, d):
    """Case versions stored by two states of the engine, the older without ``sports_code``, neither with
    ``injury_hour``, read under the declared schema: what was not stored is null."""
    from caseflow.sources.tables import read_stored
    root = scratch_path(spark, "stored")
    cases = fx.case_versions_src(spark, d).select("encounter_id", "version", "intent", "sports_code")
    cases.where("version <= 2").drop("sports_code").write.parquet(f"{root}/case_report")
    cases.where("version > 2").write.mode("append").parquet(f"{root}/case_report")
    return read_stored(spark, root, ["case_report"])["case_report"].select("encounter_id", "version", "intent", "sports_code", "injury_hour")
