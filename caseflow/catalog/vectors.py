"""Text vectors, chunking, chunk-level search, pair similarity, rerank and model
scoring (V6–V11, W6, C24), and the report for a query (P3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.catalog import register
from caseflow.catalog import sqlfrag as q
from caseflow.catalog.report import _report_sql, stored
from caseflow.catalog.search import FILTERS, NEG, POS, _cum_mass_sql, _qvec, _sem_scored_sql
from caseflow.operators import cutoffs as co
from caseflow.operators import embed as em
from caseflow.operators import search as se
from caseflow.plans import notes as nt
from caseflow.plans import query as qy
from caseflow.plans import report as rp
from caseflow.rules.vocab import NARRATIVE_NOTE_ORDER
from caseflow.sources import tables as tb

BUCKET_SQL = "CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dim}"


def _embed_sql(src: str, key: str, text: str, dim: int = 64) -> str:
    return f"""SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS weight FROM (
  SELECT {key}, {BUCKET_SQL.format(dim=dim)} AS bucket, count(*) AS c
  FROM (SELECT {key}, unnest({q.tokens(text)}) AS t FROM {src}) GROUP BY ALL)"""


@register("hash_embed", f"SELECT doc_id, bucket, round(weight, 6) AS weight FROM ({_embed_sql('documents', 'doc_id', 'text')})")
def hash_embed(spark, d):
    e = em.hash_embed(fx.read(spark, d, "documents"), "doc_id", "text")
    return e.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


NARR_SQL = f"""SELECT encounter_id, string_agg(note_type || chr(10) || chr(10) || note_text, chr(10) || chr(10)
  ORDER BY list_position({q.sql_str_list(NARRATIVE_NOTE_ORDER)}, note_type), line)
  AS narrative FROM lines WHERE note_text IS NOT NULL AND list_position(
  {q.sql_str_list(NARRATIVE_NOTE_ORDER)}, note_type) IS NOT NULL
  GROUP BY encounter_id"""


@register("pair_similarity", fx.with_views(f"""
SELECT a.encounter_id, round(sum(a.weight * b.weight), 6) AS cosine
FROM ea a JOIN eb b ON a.encounter_id = b.encounter_id AND a.bucket = b.bucket GROUP BY a.encounter_id""",
    lines=fx.NOTE_LINES_SQL, narr=NARR_SQL, summaries=fx.LATEST_SUMMARIES_SQL,
    ea=_embed_sql("narr", "encounter_id", "narrative"), eb=_embed_sql("summaries", "encounter_id", "summary_text")))
def pair_similarity(spark, d):
    """Review aid: cosine between an encounter's note narrative and its summary vector."""
    nar = nt.full_narratives(fx.note_lines_src(spark, d))
    a = em.hash_embed(nar, "encounter_id", "full_narrative")
    b = em.hash_embed(tb.latest_summaries(spark, d), "encounter_id", "summary_text")
    return em.sparse_cosine(a, b, "encounter_id").select("encounter_id", F.round("cosine", 6).alias("cosine"))


CHUNK_SQL = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)),
                             lambda x: length(x) > 0) AS sl FROM documents),
e AS (SELECT doc_id, sl[i] AS sent, i, len(string_split_regex(sl[i], '\s+')) AS n
      FROM (SELECT doc_id, sl, unnest(range(1, len(sl) + 1)) AS i FROM s)),
r AS (
  SELECT doc_id, i, n, sent, 0 AS no, n AS used FROM e WHERE i = 1
  UNION ALL
  SELECT e.doc_id, e.i, e.n, e.sent,
         CASE WHEN r.used + e.n > 128 THEN r.no + 1 ELSE r.no END,
         CASE WHEN r.used + e.n > 128 THEN e.n ELSE r.used + e.n END
  FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)
SELECT doc_id, no AS chunk_number, string_agg(sent, ' ' ORDER BY i) AS chunk_text, CAST(sum(n) AS BIGINT) AS n_tokens
FROM r GROUP BY doc_id, no"""


@register("chunk_notes", CHUNK_SQL)
def chunk_notes(spark, d):
    return em.chunk_by_size(fx.read(spark, d, "documents"), "doc_id", "text")


CHUNK_SIM_SQL = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)),
                             lambda x: length(x) > 0) AS sl FROM documents),
e0 AS (SELECT doc_id, sl[i] AS sent, i, len(string_split_regex(sl[i], '\s+')) AS n
       FROM (SELECT doc_id, sl, unnest(range(1, len(sl) + 1)) AS i FROM s)),
e1 AS (SELECT *, __TERMS__ AS terms FROM e0),
e AS (SELECT *, lag(terms) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM e1),
j AS (SELECT *, CASE WHEN len(list_distinct(list_concat(coalesce(prev, []), terms))) = 0 THEN 1.0
                     ELSE len(list_intersect(coalesce(prev, []), terms)) * 1.0
                          / len(list_distinct(list_concat(coalesce(prev, []), terms))) END AS jac FROM e),
r AS (
  SELECT doc_id, i, n, sent, 0 AS no, n AS used FROM j WHERE i = 1
  UNION ALL
  SELECT j.doc_id, j.i, j.n, j.sent,
         CASE WHEN r.used + j.n > 128 OR j.jac < 0.5 THEN r.no + 1 ELSE r.no END,
         CASE WHEN r.used + j.n > 128 OR j.jac < 0.5 THEN j.n ELSE r.used + j.n END
  FROM r JOIN j ON j.doc_id = r.doc_id AND j.i = r.i + 1)
SELECT doc_id, no AS chunk_number, string_agg(sent, ' ' ORDER BY i) AS chunk_text FROM r GROUP BY doc_id, no"""


@register("chunk_notes_similarity", CHUNK_SIM_SQL.replace("__TERMS__", q.terms("sent")))
def chunk_notes_similarity(spark, d):
    return em.chunk_texts(fx.read(spark, d, "documents"), "doc_id", "text")


def _chunks(spark, d):
    """Chunk vectors: ``embeddings`` rows as chunks of notes; a note belongs to
    encounter note_id // 4, so an encounter has several chunks."""
    e = fx.read(spark, d, "embeddings")
    chunks = e.select(F.col("vec_id").alias("note_id"), F.col("embedding").alias("vec"))
    notes = chunks.select("note_id", (F.col("note_id") / 4).cast("long").alias("encounter_id"))
    return chunks, notes


@register("semantic_chunks", fx.with_views("SELECT 1", probe=fx.QUERY_VECTOR_SQL)[:-len("SELECT 1")].rstrip() + f"""
, per_chunk AS (SELECT CAST(floor(vec_id / 4) AS BIGINT) AS encounter_id, {q.cosine_distance('embedding', 'p.qvec')} AS d
                FROM embeddings, probe p)
, scored AS (SELECT encounter_id, min(d) AS distance, greatest(0.0, 1.0 - min(d)) AS similarity FROM per_chunk
             GROUP BY encounter_id ORDER BY distance, encounter_id LIMIT 5000)""" + _cum_mass_sql("scored"))
def semantic_chunks(spark, d):
    chunks, notes = _chunks(spark, d)
    r = se.chunk_semantic_search(chunks, notes, _qvec(spark, d), "cosine", 5000, bypass_below=300)
    return r.select("encounter_id", F.round("similarity", 6).alias("similarity"))


RERANK_QUERY = "thon thor des ing"


def _rerank_sql(candidates_where: str) -> str:
    qterms = "['des', 'ing', 'thon', 'thor']"
    return fx.with_views("SELECT 1", summaries=fx.LATEST_SUMMARIES_SQL)[:-len("SELECT 1")].rstrip() + f"""
, scored AS (SELECT encounter_id, 1.0 / (1.0 + exp(1.0 - CAST(len(list_intersect({q.terms('summary_text')}, {qterms})) AS DOUBLE)))
               AS similarity FROM summaries WHERE {candidates_where})""" + _cum_mass_sql("scored").replace(
        "n < 300 OR ", "").replace("pos <= greatest(i, 0)", "pos < greatest(i, 1)")


KW_WHERE = (f"list_has_any({q.terms('summary_text')}, ['thon', 'thor']) "
            f"AND NOT list_has_any({q.terms('summary_text')}, ['que'])")


def _rerank(spark, d, candidates):
    texts = tb.latest_summaries(spark, d).join(candidates, "encounter_id", "left_semi")
    scored = em.overlap_relevance(texts, "summary_text", RERANK_QUERY).select(
        "encounter_id", F.col("relevance").alias("similarity"))
    # candidate lists are not bounded by a top-k, so the distributed form is used
    cut = co.cumulative_mass_global(scored, "similarity", "encounter_id", inclusive=False)
    return cut.select("encounter_id", F.round("similarity", 6).alias("similarity"))


@register("rerank_candidates", _rerank_sql(KW_WHERE))
def rerank_candidates(spark, d):
    kw = se.keyword_keys(tb.latest_summaries(spark, d), "summary_text", POS, NEG)
    return _rerank(spark, d, kw)


@register("rerank_cut", _rerank_sql("true"))
def rerank_cut(spark, d):
    return _rerank(spark, d, tb.latest_summaries(spark, d).select("encounter_id"))


@register("score_external_model", """SELECT doc_id, least(length(text) / 1000.0, 1.0) AS score FROM documents""")
def score_external_model(spark, d):
    """The model hook: a model loaded once per task scores batches of texts."""
    from caseflow.operators.scoring import model_scores

    def load():
        return lambda texts: [min(len(t) / 1000.0, 1.0) for t in texts]
    return model_scores(fx.read(spark, d, "documents"), load, "doc_id", "text")


@register("score_documents")
def score_documents(spark, d):
    from caseflow.operators.scoring import score_corpus
    return score_corpus(fx.read(spark, d, "documents"), fx.read(spark, d, "labels"))


def _report_by_query_sql() -> str:
    sem = f"""
, scored AS (SELECT encounter_id, d AS distance, greatest(0.0, 1.0 - d) AS similarity FROM (
    SELECT v.encounter_id, {q.cosine_distance('v.vec', 'p.qvec')} AS d FROM vectors v, probe p)
  ORDER BY distance, encounter_id LIMIT 5000)""" + _cum_mass_sql("scored").replace(
        "SELECT encounter_id, round(similarity, 6) AS similarity FROM ranked, idx",
        ", sem AS (SELECT encounter_id FROM ranked, idx") + f""")
, kw AS (SELECT DISTINCT encounter_id FROM ({fx.LATEST_SUMMARIES_SQL}) WHERE {KW_WHERE})
, flt AS (SELECT encounter_id FROM encounters WHERE ctas <= 3)
, qkeys AS (SELECT encounter_id FROM kw INTERSECT SELECT encounter_id FROM sem INTERSECT SELECT encounter_id FROM flt)"""
    return _report_sql("SELECT * FROM report",
                       sel="SELECT * FROM encounters WHERE encounter_id IN (SELECT encounter_id FROM qkeys)",
                       extra=sem, vectors=fx.VECTORS_SQL, probe=fx.QUERY_VECTOR_SQL)


QUERY = {"keywords": {"positive": POS, "negative": NEG, "detail_level": 1},
         "semantic": {"description": "the probe", "detail_level": 1, "metric": "cosine", "limit": 5000},
         "filters": FILTERS}


def _query_tables(spark, d) -> dict:
    """The stored tables, with the ``embeddings`` rows as vectors: of summaries, processed notes
    and chunks (a note belongs to encounter note_id // 4)."""
    t = stored(spark, d)
    vec = fx.vectors_src(spark, d)
    chunks, chunk_notes = _chunks(spark, d)
    t["summaries"] = t["summaries"].join(vec, "encounter_id", "full").withColumn("version", F.coalesce("version", F.lit(1)))
    t["processed_notes"] = (fx.notes_src(spark, d).select("encounter_id", "note_text").join(vec, "encounter_id", "left"))
    t["chunked_notes"] = chunks
    t["notes"] = fx.notes_src(spark, d).select("encounter_id", "note_text").join(
        chunk_notes.withColumnRenamed("encounter_id", "owner"), F.col("encounter_id") == F.col("note_id"), "left")
    t["notes"] = t["notes"].select(F.coalesce("owner", "encounter_id").alias("encounter_id"), "note_id", "note_text")
    return t


def _run(spark, d, query, **options):
    probe = _qvec(spark, d)
    t = _query_tables(spark, d)
    t["summaries"] = t["summaries"].where(F.col("vec").isNotNull()) if "semantic" in query else t["summaries"]
    return qy.search_keys(t, query, embed=lambda text, small: probe, bypass_below=300, **options)


@register("report_by_query", _report_by_query_sql())
def report_by_query(spark, d):
    """A query dict compiled to the report."""
    return rp.report_by_keys(stored(spark, d), _run(spark, d, QUERY))


def _keys_sql(text_sql: str, where: str) -> str:
    return f"SELECT DISTINCT encounter_id FROM ({text_sql}) t WHERE {where}"


@register("query_keywords_narrative", _keys_sql(
    f"SELECT encounter_id, full_narrative FROM ({tb.ENCOUNTERS_SQL}) e",
    f"list_has_any({q.terms('full_narrative')}, ['fracture', 'burn']) AND NOT list_has_any({q.terms('full_narrative')}, ['skull'])"))
def query_keywords_narrative(spark, d):
    return _run(spark, d, {"keywords": {"positive": ["fracture", "Burn"], "negative": ["skull"], "detail_level": 2}})


@register("query_keywords_notes", _keys_sql(
    """SELECT CASE WHEN vec_id IS NULL THEN doc_id ELSE CAST(floor(doc_id / 4) AS BIGINT) END AS encounter_id, text
       FROM documents LEFT JOIN embeddings ON vec_id = doc_id""", f"list_has_any({q.terms('text')}, ['thon', 'thor'])"))
def query_keywords_notes(spark, d):
    return _run(spark, d, {"keywords": {"positive": POS, "detail_level": 3}})


@register("query_rerank", _rerank_sql(KW_WHERE).replace("round(similarity, 6) AS similarity ", ""). replace(
    "SELECT encounter_id, FROM ranked", "SELECT encounter_id FROM ranked"))
def query_rerank(spark, d):
    return _run(spark, d, {"keywords": {"positive": POS, "negative": NEG},
                           "rerank": {"prompt": RERANK_QUERY, "detail_level": 1}})


@register("query_chunks_filtered", fx.with_views("SELECT 1", probe=fx.QUERY_VECTOR_SQL)[:-len("SELECT 1")].rstrip() + f"""
, per AS (SELECT CAST(floor(vec_id / 4) AS BIGINT) AS encounter_id, min({q.l2('embedding', 'p.qvec')}) AS distance
          FROM embeddings JOIN documents ON doc_id = vec_id, probe p GROUP BY 1)
, near AS (SELECT encounter_id FROM per ORDER BY distance, encounter_id LIMIT 100)
SELECT encounter_id FROM near JOIN ({tb.ENCOUNTERS_SQL}) e USING (encounter_id) WHERE sex = 'F'""")
def query_chunks_filtered(spark, d):
    return _run(spark, d, {"semantic": {"description": "the probe", "detail_level": 3, "metric": "L2", "limit": 100},
                           "filters": {"encounters": {"sex": {"eq": "F"}}}})
