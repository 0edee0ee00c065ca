"""Streaming drops, log capture and log views (ST1–ST3, W7, J14), and the daily batch (P1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.catalog import ORACLE, register
from caseflow.catalog import sqlfrag as q
from caseflow.catalog.sources import DUMP_HEADER, write_document_dump
from caseflow.catalog.text import collapse_sql, expand_sql
from caseflow.plans.daily import daily_batch
from caseflow.session import scratch_path
from caseflow.streaming import drops as st


def _file_drop(spark, d):
    drop_dir, header = write_document_dump(spark, d).rstrip("*").rstrip("/"), DUMP_HEADER.split("|")
    return st.read_file_drop(spark, st.run_file_drop(spark, drop_dir, header, "doc_id"), header)


@register("stream_file_drop")
def stream_file_drop(spark, d):
    return _file_drop(spark, d)[0]


@register("stream_file_drop_rejects")
def stream_file_drop_rejects(spark, d):
    return _file_drop(spark, d)[1]


ORACLE["stream_file_drop"] = ORACLE["src_note_dump"]
ORACLE["stream_file_drop_rejects"] = ORACLE["src_note_dump_rejects"]


def _year_drops(spark, d) -> tuple[str, object]:
    """Visits written as one drop per arrival year; each drop also repeats the last
    month of the year before, so keys recur across drops."""
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("encounter_id"),
                                          F.col("o_custkey").alias("subject_id"), "o_orderdate")
    y = F.year("o_orderdate")
    again = o.where(F.month("o_orderdate") == 12).withColumn("drop_year", y + 1)
    allrows = o.withColumn("drop_year", y).unionByName(again)
    path = scratch_path(spark, "visit_drops")
    allrows.write.partitionBy("drop_year").parquet(path)
    schema = allrows.drop("drop_year").schema
    return path, schema


@register("stream_new_keys", "SELECT DISTINCT o_orderkey AS encounter_id FROM orders")
def stream_new_keys(spark, d):
    path, schema = _year_drops(spark, d)
    from pyspark.sql.types import LongType, StructField, StructType, TimestampType
    sch = StructType([StructField("encounter_id", LongType()), StructField("subject_id", LongType()),
                      StructField("o_orderdate", TimestampType())])
    table = st.run_new_keys(spark, path, sch, "encounter_id", scratch_path(spark, "encounter_keys"))
    return spark.read.parquet(table).select("encounter_id")


@register("log_append_parse", """
SELECT event_id, user_id, event_type AS action, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events""")
def log_append_parse(spark, d):
    ev = fx.read(spark, d, "events")
    src = scratch_path(spark, "event_files")
    ev.write.parquet(src)
    out = st.run_log_stream(spark, src, ev.schema)
    return spark.read.parquet(out).select("event_id", "user_id", "action", "ts", "k")


@register("log_parameters", """
SELECT event_id, event_type AS action, CAST(value AS DOUBLE) AS value, CAST(1 + (value IS NOT NULL)::INT AS INTEGER) AS n_keys FROM events""")
def log_parameters(spark, d):
    """The stored JSON parameters of every action, read back: an absent value is an absent key."""
    ev = fx.read(spark, d, "events")
    src = scratch_path(spark, "event_files")
    ev.write.parquet(src)
    p = F.from_json("parameters", "action string, value double")
    return (spark.read.parquet(st.run_log_stream(spark, src, ev.schema))
            .select("event_id", p["action"].alias("action"), p["value"].alias("value"),
                    F.json_object_keys("parameters").alias("_k")).withColumn("n_keys", F.size("_k")).drop("_k"))


@register("user_log_one", """
SELECT user_id, event_id, ts, event_type FROM events
WHERE user_id = (SELECT max(user_id) FROM events) ORDER BY ts DESC, event_id DESC""")
def user_log_one(spark, d):
    """One user's log, newest first: the filter reaches the scan, the sort holds one user."""
    ev = fx.read(spark, d, "events")
    user = ev.agg(F.max("user_id")).first()[0]  # a query parameter: one value
    return (ev.where(F.col("user_id") == user).select("user_id", "event_id", "ts", "event_type")
            .orderBy(F.col("ts").desc(), F.col("event_id").desc()))


@register("user_log_history", """
SELECT user_id, event_id, ts, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC""")
def user_log_history(spark, d):
    """Every user's log, newest first. A global sort: range partitioning splits even a
    user with a third of all events across tasks (no per-user window)."""
    ev = fx.read(spark, d, "events")
    return ev.select("user_id", "event_id", "ts", "event_type").orderBy(
        "user_id", F.col("ts").desc(), F.col("event_id").desc())


@register("managed_user_logs", """
SELECT m.manager_id, e.event_type, count(*) AS n_events, count(DISTINCT e.user_id) AS n_users
FROM (SELECT DISTINCT user_id, user_id % 10 AS manager_id FROM events) m
JOIN events e ON e.user_id = m.user_id GROUP BY m.manager_id, e.event_type""")
def managed_user_logs(spark, d):
    """Manager → managed users (manager = user_id mod 10 in the fixture) → their logs."""
    ev = fx.read(spark, d, "events")
    managed = ev.select("user_id", (F.col("user_id") % 10).alias("manager_id")).distinct()
    logs = ev.join(managed, "user_id", "inner")
    return logs.groupBy("manager_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"),
                                                        F.countDistinct("user_id").alias("n_users"))


# ---------------------------------------------------------------- the daily batch
def _batch_sources(spark, d) -> dict:
    from caseflow.catalog.coding import _intent_parsed
    from caseflow.operators.aggregates import ordered_join
    from caseflow.sources import tables as tb
    return {"lines": fx.note_lines_src(spark, d), "visits": fx.visits_src(spark, d), "subjects": fx.subjects_src(spark, d),
            "problem_lists": fx.problems_src(spark, d).groupBy("encounter_id").agg(
                ordered_join([], F.col("problem"), ", ").alias("problem_list")),
            "referrals": fx.referrals_src(spark, d), "answers": _intent_parsed(spark, d),
            "history": tb.stored_encounters(spark, d)}


def _daily_sql() -> str:
    from caseflow.catalog import coding as cd
    sql = cd._cases_sql(cd.FLAG_SQL[:cd.FLAG_SQL.index("WHERE e.arrival_date")]
                        + "WHERE e.encounter_id IN (SELECT conv_id FROM conversations)")
    i = sql.rindex("SELECT encounter_id,\n  CASE WHEN (CASE")
    merged = expand_sql(collapse_sql("t"))
    return sql[:i] + f""", case_rows AS ({sql[i:]}),
merged AS (SELECT encounter_id, {merged} AS note_text FROM (
  SELECT encounter_id, string_agg(coalesce(note_text, 'None'), ' ' ORDER BY note_type, line, coalesce(note_text, 'None')) AS t
  FROM lines WHERE note_type IN ('ED Provider Notes', 'ED Triage Notes') GROUP BY encounter_id))
SELECT m.encounter_id, regexp_replace(regexp_replace(regexp_replace(lower(m.note_text), ' +', ' ', 'g'),
         'mrn(:| )*[0-9]+', '[redacted]', 'g'), ' dob(:| )*[0-9]+/[0-9]+/[0-9]+', 'pt', 'g') AS processed_notes,
       f.is_case, c.no1, c.bp1, c.disp, c.am_pm
FROM merged m JOIN flagged f USING (encounter_id) LEFT JOIN case_rows c USING (encounter_id)"""


@register("pipeline_daily", _daily_sql())
def pipeline_daily(spark, d):
    """The daily batch end to end on the note lines present: merge lines, expand terms, cut
    sections, de-identify, build and store every table, flag with the learned cutoff, code the
    cases. Returns the stored processed notes with the case codes."""
    from caseflow.catalog.coding import BATCH_START
    t = daily_batch(_batch_sources(spark, d), scratch_path(spark, "daily"), BATCH_START, grain="month")
    return (t["processed_notes"].join(t["flagged"].select("encounter_id", "is_case"), "encounter_id", "inner")
            .join(t["case_report"].select("encounter_id", "no1", "bp1", "disp", "am_pm"), "encounter_id", "left")
            .select("encounter_id", F.col("note_text").alias("processed_notes"), "is_case", "no1", "bp1", "disp", "am_pm"))


_IN = "encounter_id IN (SELECT conv_id FROM conversations)"


@register("pipeline_daily_tables", fx.with_views(f"""
SELECT 'subjects' AS table_name, count(DISTINCT subject_id) AS n_rows FROM visits WHERE {_IN}
UNION ALL SELECT 'encounters', count(*) FROM visits WHERE {_IN}
UNION ALL SELECT 'processed_notes', count(DISTINCT encounter_id) FROM lines WHERE note_type <> 'Consults'
UNION ALL SELECT 'notes', count(DISTINCT note_id) FROM lines
UNION ALL SELECT 'problems', count(*) FROM (SELECT DISTINCT encounter_id, problem FROM problems WHERE {_IN})
UNION ALL SELECT 'referrals', count(*) FROM (SELECT DISTINCT encounter_id, referral FROM refs WHERE {_IN})
UNION ALL SELECT 'summaries', count(*) FROM visits WHERE {_IN}""",
    visits=fx.VISITS_SQL, lines=fx.NOTE_LINES_SQL, problems=fx.PROBLEMS_SQL, refs=fx.REFERRALS_SQL))
def pipeline_daily_tables(spark, d):
    """Rows per stored table after running the same batch twice: the second run adds nothing."""
    from caseflow.catalog.coding import BATCH_START
    root = scratch_path(spark, "daily")
    daily_batch(_batch_sources(spark, d), root, BATCH_START, grain="month")
    t = daily_batch(_batch_sources(spark, d), root, BATCH_START, grain="month")
    out = None
    for name in ("subjects", "encounters", "processed_notes", "notes", "problems", "referrals", "summaries"):
        n = t[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


# ---------------------------------------------------------------- late lines
def _late_tables(spark, d, postings: dict | None = None) -> dict:
    """The stored tables after two days: the first brings every visit's first two lines, the second the
    rest (late lines of stored visits)."""
    from caseflow.catalog.coding import BATCH_START
    root = scratch_path(spark, "daily-late")
    src = _batch_sources(spark, d)
    days = [{**src, "lines": src["lines"].where("line <= 2")}, {**src, "lines": src["lines"].where("line > 2")}]
    for day in days:
        t = daily_batch(day, root, BATCH_START, grain="month", postings=postings)
    return t


@register("pipeline_daily_late", fx.with_views("""
SELECT note_id, min(encounter_id) AS encounter_id, min(note_type) AS note_type,
       string_agg(coalesce(note_text, 'None'), ' ' ORDER BY line, coalesce(note_text, 'None')) AS note_text
FROM (SELECT DISTINCT * FROM lines) GROUP BY note_id""", lines=fx.NOTE_LINES_SQL))
def pipeline_daily_late(spark, d):
    """Stored notes after late lines: as if all lines had come at once."""
    return _late_tables(spark, d)["notes"].select("note_id", "encounter_id", "note_type", "note_text")


_WORDS = {"keywords": {"positive": ["thon", "thor"], "negative": ["que"], "detail_level": 2}}


@register("pipeline_daily_keywords", f"""
SELECT encounter_id FROM ({ORACLE["full_narrative"]}) n
WHERE list_has_any({q.terms('full_narrative')}, ['thon', 'thor']) AND NOT list_has_any({q.terms('full_narrative')}, ['que'])""")
def pipeline_daily_keywords(spark, d):
    """A keyword search in the narratives, answered by the postings that the batch grew on two days: narratives
    that late lines changed count as they are now."""
    from caseflow.operators.postings import Postings
    from caseflow.plans.query import search_keys
    postings = {"encounters": Postings(spark, scratch_path(spark, "postings"))}
    return search_keys(_late_tables(spark, d, postings), _WORDS, postings=postings)


@register("pipeline_daily_vectors", f"""
WITH merged AS (SELECT * FROM ({_daily_sql()})),
tok AS (SELECT encounter_id, unnest({q.tokens('processed_notes')}) AS t FROM merged),
cnt AS (SELECT encounter_id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 1024 AS bucket, count(*) AS c FROM tok GROUP BY ALL)
SELECT encounter_id, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY encounter_id)) AS FLOAT) AS weight FROM cnt""")
def pipeline_daily_vectors(spark, d):
    """The stored vectors of the processed notes, by their places that are not zero."""
    from caseflow.catalog.coding import BATCH_START
    t = daily_batch(_batch_sources(spark, d), scratch_path(spark, "daily"), BATCH_START, grain="month")
    return t["processed_notes"].select("encounter_id", F.posexplode("vec").alias("bucket", "weight")).where("weight <> 0").select(
        "encounter_id", F.col("bucket").cast("long").alias("bucket"), "weight")


_QUERY = {"semantic": {"description": "patient fell and hurt the left hand", "detail_level": 2, "limit": 50}}


def _similar_sql() -> str:
    from caseflow.operators.embed import embed_query
    q_ = {i: w for i, w in enumerate(embed_query(_QUERY["semantic"]["description"])) if w}
    values = ", ".join(f"({i}, CAST({w!r} AS DOUBLE))" for i, w in q_.items())
    return f"""WITH vec AS ({ORACLE["pipeline_daily_vectors"]}),
sim AS (SELECT m.encounter_id, 1.0 - coalesce(sum(v.weight::DOUBLE * p.w), 0.0) AS distance
        FROM (SELECT DISTINCT encounter_id FROM vec) m LEFT JOIN vec v USING (encounter_id)
             LEFT JOIN (VALUES {values}) p(bucket, w) ON p.bucket = v.bucket GROUP BY m.encounter_id)
SELECT encounter_id, round(distance, 5) AS distance FROM sim ORDER BY distance, encounter_id LIMIT 50"""


@register("pipeline_daily_nearest", _similar_sql())
def pipeline_daily_nearest(spark, d):
    """A description in words against the vectors that the batch stored: its 50 nearest visits."""
    from caseflow.catalog.coding import BATCH_START
    from caseflow.operators import embed as em
    from caseflow.operators import search as se
    t = daily_batch(_batch_sources(spark, d), scratch_path(spark, "daily"), BATCH_START, grain="month")
    spec = _QUERY["semantic"]
    hits = se.semantic_search(t["processed_notes"], em.embed_query(spec["description"]), "cosine", spec["limit"],
                              lambda top, **_: top, unit=True)
    return hits.select("encounter_id", F.round("distance", 5).alias("distance"))
