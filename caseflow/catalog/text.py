"""Note text jobs: merging, narrative, remarks, abbreviation expansion, sections,
de-identification and word windows (A1–A5, A12, C1–C5, J10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.catalog import register
from caseflow.catalog import sqlfrag as q
from caseflow.functions import text as tx
from caseflow.operators import deid as dd
from caseflow.operators import sections as sc
from caseflow.operators.aggregates import ordered_join, problem_list
from caseflow.plans import notes as nt
from caseflow.rules.vocab import ABBREVIATIONS, NARRATIVE_NOTE_ORDER, REMARK_DISPOSITIONS

LINES = dict(lines=fx.NOTE_LINES_SQL)


def expand_sql(expr: str) -> str:
    """Oracle form of the abbreviation chain: RE2 has no look-around, so each term uses
    captured edge characters and runs twice (neighbouring hits share an edge). Hits are
    first marked with a non-alphanumeric placeholder, so edges are judged on the text as
    it was before this term, then the placeholder becomes the expansion."""
    out = expr
    mark = "chr(1)"
    for term, repl in ABBREVIATIONS:
        t = term.replace("'", "''")
        r = repl.replace("'", "''")
        pat = f"(^|[^a-zA-Z0-9]){t}($|[^a-zA-Z0-9])"
        # Symbol-only terms can sit next to each other with no separator: one more pass
        # per neighbour (runs in the fixture data are at most a few characters long).
        passes = 2 if any(ch.isalnum() for ch in term) else 8
        for _ in range(passes):
            out = f"regexp_replace({out}, '{pat}', '\\1' || {mark} || '\\2', 'g')"
        out = f"replace({out}, {mark}, '{r}')"
    return out


def collapse_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


@register("merge_note_lines", fx.with_views(f"""
SELECT encounter_id, {expand_sql(collapse_sql('t'))} AS note_text FROM (
  SELECT encounter_id, string_agg(coalesce(note_text, 'None'), ' ' ORDER BY note_type, line, coalesce(note_text, 'None')) AS t
  FROM lines WHERE note_type IN ('ED Provider Notes', 'ED Triage Notes') GROUP BY encounter_id)""", **LINES))
def merge_note_lines(spark, d):
    return nt.merge_note_lines(fx.note_lines_src(spark, d))


@register("expand_terms", fx.with_views(f"SELECT doc_id, {expand_sql(collapse_sql('text'))} AS text FROM documents"))
def expand_terms(spark, d):
    doc = fx.read(spark, d, "documents")
    return doc.select("doc_id", tx.expand_terms(tx.collapse_ws("text")).alias("text"))


@register("collapse_whitespace", f"SELECT doc_id, {collapse_sql('text')} AS text FROM documents")
def collapse_whitespace(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", tx.collapse_ws("text").alias("text"))


@register("notes_build", fx.with_views("""
SELECT note_id, min(encounter_id) AS encounter_id, min(note_type) AS note_type, min(author_type) AS author_type,
       min(author_service) AS author_service,
       string_agg(coalesce(note_text, 'None'), ' ' ORDER BY line, coalesce(note_text, 'None')) AS note_text
FROM lines GROUP BY note_id""", **LINES))
def notes_build(spark, d):
    return nt.merge_note_ids(fx.note_lines_src(spark, d))


@register("full_narrative", fx.with_views(f"""
SELECT encounter_id, string_agg(note_type || chr(10) || chr(10) || note_text, chr(10) || chr(10)
       ORDER BY rnk, line, note_type || chr(10) || chr(10) || note_text) AS full_narrative
FROM (SELECT *, list_position({q.sql_str_list(NARRATIVE_NOTE_ORDER)}, note_type) AS rnk FROM lines
      WHERE note_text IS NOT NULL) x
WHERE rnk IS NOT NULL GROUP BY encounter_id""", **LINES))
def full_narrative(spark, d):
    return nt.full_narratives(fx.note_lines_src(spark, d))


@register("visit_remark", fx.with_views(f"""
SELECT l.encounter_id,
  CASE WHEN lower(v.disposition) IN ({", ".join("'" + x + "'" for x in REMARK_DISPOSITIONS)}) THEN lower(v.disposition)
       WHEN bool_or(contains(l.note_text, 'Consults') OR contains(l.note_text, 'Consult Follow Up')) THEN 'Consult'
       WHEN bool_or(l.note_type = 'ED Provider Notes')
            AND strpos(lower(string_agg(CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END, ' '
                        ORDER BY l.line, CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END)),
                       'assessment and plan') > 0
       THEN substr(string_agg(CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END, ' '
                        ORDER BY l.line, CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END),
                   strpos(lower(string_agg(CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END, ' '
                        ORDER BY l.line, CASE WHEN l.note_type = 'ED Provider Notes' THEN coalesce(l.note_text, 'None') END)),
                          'assessment and plan'))
       ELSE '' END AS remark
FROM lines l JOIN visits v ON v.encounter_id = l.encounter_id
GROUP BY l.encounter_id, v.disposition""", visits=fx.VISITS_SQL, **LINES))
def visit_remark(spark, d):
    return nt.visit_remarks(fx.note_lines_src(spark, d), fx.visits_src(spark, d))


@register("problem_list_agg", fx.with_views("""
SELECT encounter_id, string_agg(problem, ',' ORDER BY problem) AS problem_list
FROM problems WHERE problem IS NOT NULL GROUP BY encounter_id""", problems=fx.PROBLEMS_SQL))
def problem_list_agg(spark, d):
    return problem_list(fx.problems_src(spark, d))


# ------------------------------------------------------------------ sections
# Section-cutting input: each document's whole text, lower-cased (so that it holds no
# header literal) and cut by word position into six pieces p0..p5, put together as
#   p0 "Chief Complaint:" p1 "PMH:" p2 "Assessment and Plan" p3 "DIAGNOSES" p4 "Social History:" p5
# Expected: chief complaint + plan kept first (p1 p3), then unlabelled (p0, p4); p2, p5 dropped.
SECTION_HEADS = ["Chief Complaint:", "PMH:", "Assessment and Plan", "DIAGNOSES", "Social History:"]


def _pieces_spark(words):
    n = F.size(words)
    return [F.array_join(F.filter(words, lambda w, i: F.floor(i * 6 / n) == j), " ") for j in range(6)]


def _section_input(spark, d):
    doc = fx.read(spark, d, "documents").withColumn(
        "_w", F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " "))
    p = _pieces_spark(F.col("_w"))
    parts = [p[0]]
    for j, h in enumerate(SECTION_HEADS):
        parts += [F.lit(h), p[j + 1]]
    return doc.select("doc_id", F.concat_ws(" ", *parts).alias("text"))


def _pieces_sql() -> str:
    cols = ", ".join(
        f"array_to_string(list_filter(w, lambda x, i: floor((i - 1) * 6 / n) = {j}), ' ') AS p{j}" for j in range(6))
    return f"""SELECT doc_id, {cols} FROM (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents))"""


@register("section_filter", fx.with_views("""
SELECT doc_id, array_to_string(list_filter([p1, p3, p0, p4], lambda x: length(x) > 0), ' ') AS text FROM pieces""",
    pieces=_pieces_sql()))
def section_filter(spark, d):
    return sc.filter_sections(_section_input(spark, d), "text").select("doc_id", "text")


@register("section_profile", """
SELECT category, (SELECT count(*) FROM documents) AS n_sections
FROM (VALUES ('chief_complaint'), ('past_medical_history'), ('observation_and_plan'), ('diagnoses'),
             ('social_history')) t(category)""")
def section_profile(spark, d):
    return sc.section_profile(_section_input(spark, d), "text")


# ------------------------------------------------------------------ de-identification
# Names: per conversation, the 2nd and 4th words of its first line (so they occur in its notes).
def _names(spark, d):
    c = fx.read(spark, d, "conversations").where(F.col("turn") == 0)
    w = F.split(F.regexp_replace(F.lower(F.col("text")), " +", " "), " ")
    return c.select(F.col("conv_id").alias("encounter_id"),
                    F.concat_ws(", ", F.get(w, 1), F.get(w, 3)).alias("subject_name"))


def _notes(spark, d):
    lines = fx.note_lines_src(spark, d)
    return lines.groupBy("encounter_id").agg(
        ordered_join([F.col("line"), F.col("note_type")], F.col("note_text"), " ").alias("note_text"))


NAMES_SQL = """SELECT conv_id AS encounter_id,
  concat_ws(', ', string_split(regexp_replace(lower(text), ' +', ' ', 'g'), ' ')[2],
                  string_split(regexp_replace(lower(text), ' +', ' ', 'g'), ' ')[4]) AS subject_name
FROM conversations WHERE turn = 0"""
DEID_NOTES_SQL = """SELECT encounter_id, string_agg(note_text, ' ' ORDER BY line, note_type, note_text) AS note_text
FROM lines GROUP BY encounter_id"""
# DuckDB's edit distance counts bytes; the oracle maps each accented letter to one
# spare control character first so that both sides count characters.
_ACCENTED = "ßàáâäçèéêëìíîïñòóôöùúûüœæåøÿ"
_SPARE = "".join(chr(c) for c in list(range(1, 9)) + [11, 12] + list(range(14, 32)))[:len(_ACCENTED)]


def _one_byte(expr: str) -> str:
    return f"translate({expr}, '{_ACCENTED}', '{_SPARE}')"


NAME_WORDS_SQL = """SELECT DISTINCT encounter_id, name_word,
  CASE WHEN length(name_word) < 4 THEN 0 WHEN length(name_word) < 6 THEN 1 ELSE 2 END AS tol
FROM (SELECT encounter_id, unnest(regexp_split_to_array(lower(subject_name), '[\\s,.;]+')) AS name_word FROM names)
WHERE length(name_word) > 0"""
# The fixture's texts hold no apostrophes or hyphens inside words, so the plain run is enough here;
# tests/test_text.py holds hand-written texts with those.
NOTE_WORDS_SQL = r"""SELECT encounter_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (
  SELECT encounter_id, regexp_extract_all(regexp_replace(lower(note_text), ' +', ' ', 'g'), '[\pL\pM\pN]+') AS w FROM notes)"""
NOTE_RUNS_SQL = r"""SELECT encounter_id, unnest(w) AS run, generate_subscripts(w, 1) AS i FROM (
  SELECT encounter_id, regexp_extract_all(regexp_replace(lower(note_text), ' +', ' ', 'g'),
         '[\pL\pM\pN]+|[^\pL\pM\pN]+') AS w FROM notes)"""
MATCH_SQL = f"""SELECT w.encounter_id, w.pos, w.word, n.name_word FROM words w JOIN namew n ON n.encounter_id = w.encounter_id
WHERE levenshtein({_one_byte('n.name_word')}, {_one_byte('w.word')}) <= n.tol"""
DEID_VIEWS = dict(lines=fx.NOTE_LINES_SQL, names=NAMES_SQL, notes=DEID_NOTES_SQL, namew=NAME_WORDS_SQL,
                  words=NOTE_WORDS_SQL, matches=MATCH_SQL)


@register("fuzzy_name_match", fx.with_views("SELECT * FROM matches", **DEID_VIEWS))
def fuzzy_name_match(spark, d):
    return dd.fuzzy_name_matches(_notes(spark, d), _names(spark, d))


@register("deidentify_notes", fx.with_views("""
SELECT encounter_id,
  regexp_replace(regexp_replace(string_agg(CASE WHEN hit THEN 'pt' ELSE run END, '' ORDER BY i),
                 'mrn(:| )*[0-9]+', '[redacted]', 'g'), ' dob(:| )*[0-9]+/[0-9]+/[0-9]+', 'pt', 'g') AS note_text
FROM (SELECT r.encounter_id, r.i, r.run,
             EXISTS (SELECT 1 FROM matches m WHERE m.encounter_id = r.encounter_id AND m.word = r.run) AS hit
      FROM runs r) x
GROUP BY encounter_id""", **DEID_VIEWS, runs=NOTE_RUNS_SQL))
def deidentify_notes(spark, d):
    return dd.deidentify(_notes(spark, d), _names(spark, d))


@register("redact_identifiers", """
SELECT doc_id, regexp_replace(regexp_replace(text, 'mrn(:| )*[0-9]+', '[redacted]', 'g'),
                              ' dob(:| )*[0-9]+/[0-9]+/[0-9]+', 'pt', 'g') AS text FROM documents""")
def redact_identifiers(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", tx.redact_identifiers(F.col("text")).alias("text"))


@register("split_word_windows", """
SELECT encounter_id, i AS window_no,
       array_to_string(list_slice(w, i * sz + 1, i * sz + sz), ' ') AS window_text
FROM (SELECT encounter_id, w, n, CAST(ceil(len(w) / n) AS BIGINT) AS sz, unnest(range(0, n)) AS i FROM (
        SELECT doc_id AS encounter_id, string_split(text, ' ') AS w,
               CAST(ceil(len(string_split(text, ' ')) / 512) AS BIGINT) AS n FROM documents))""")
def split_word_windows(spark, d):
    doc = fx.read(spark, d, "documents").select(F.col("doc_id").alias("encounter_id"), F.col("text").alias("note_text"))
    return dd.word_windows(doc)


@register("check_single_name", """
SELECT encounter_id, n_names FROM (
  SELECT conv_id AS encounter_id, count(DISTINCT text) AS n_names
  FROM conversations WHERE role = 'user' GROUP BY conv_id) WHERE n_names > 1""")
def check_single_name(spark, d):
    # Stand-in: each user line's whole text as the name carried on that line.
    c = fx.read(spark, d, "conversations").where(F.col("role") == "user")
    return dd.check_single_name(c.select(F.col("conv_id").alias("encounter_id"), F.col("text").alias("subject_name")))
