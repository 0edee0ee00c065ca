"""Keyword, vector and combined search (K1–K5, V1–V6, W1–W5, T1–T2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow import fixtures as fx
from caseflow.catalog import register
from caseflow.catalog import sqlfrag as q
from caseflow.catalog.report import stored
from caseflow.functions import text as tx
from caseflow.operators import cutoffs as co
from caseflow.operators import search as se
from caseflow.plans.notes import full_narratives
from caseflow.rules.vocab import CUTOFF_BYPASS_ROWS, NARRATIVE_NOTE_ORDER, SEMANTIC_TOP_K
from caseflow.sources import tables as tb

POS, NEG = ["thon", "Thor"], ["que"]


def _summaries(spark, d):
    return tb.latest_summaries(spark, d)


def _qvec(spark, d) -> list[float]:
    """The probe vector is a query parameter (as if embedded on the client): one
    64-float row fetched from the data, never the data itself."""
    return list(fx.query_vector_src(spark, d).first()["qvec"])


SUM = dict(summaries=fx.LATEST_SUMMARIES_SQL)


@register("text_terms", fx.with_views(
    f"SELECT encounter_id, array_to_string(list_sort({q.terms('summary_text')}), ' ') AS terms FROM summaries", **SUM))
def text_terms(spark, d):
    s = _summaries(spark, d)
    return s.select("encounter_id", F.array_join(F.array_sort(tx.search_terms("summary_text")), " ").alias("terms"))


@register("keyword_search", fx.with_views(f"""
SELECT DISTINCT encounter_id FROM summaries
WHERE list_has_any({q.terms('summary_text')}, ['thon', 'thor'])
  AND NOT list_has_any({q.terms('summary_text')}, ['que'])""", **SUM))
def keyword_search(spark, d):
    return se.keyword_keys(_summaries(spark, d), "summary_text", POS, NEG)


def _stem_sql(text: str) -> str:
    from caseflow.functions.stems import stem_sql
    return stem_sql(f"SELECT DISTINCT unnest({q.terms(text)}) AS term FROM summaries "
                    "UNION SELECT unnest(['running', 'handed', 'ques'])")


HAS_SQL = f"""SELECT DISTINCT s.encounter_id, x.stem
FROM (SELECT encounter_id, unnest({q.terms('summary_text')}) AS term FROM summaries) s JOIN stems x USING (term)"""
STEMS = dict(**SUM, stems=_stem_sql("summary_text"), has_stem=HAS_SQL)


@register("text_terms_stemmed", fx.with_views(
    "SELECT encounter_id, string_agg(stem, ' ' ORDER BY stem) AS stems FROM has_stem GROUP BY encounter_id", **STEMS))
def text_terms_stemmed(spark, d):
    from caseflow.functions.stems import stemmed_terms
    rows = stemmed_terms(_summaries(spark, d), "encounter_id", "summary_text")
    return rows.groupBy("encounter_id").agg(F.array_join(F.array_sort(F.collect_list("stem")), " ").alias("stems"))


@register("keyword_search_stemmed", fx.with_views("""
SELECT DISTINCT encounter_id FROM has_stem WHERE stem IN (SELECT stem FROM stems WHERE term IN ('running', 'handed'))
  AND encounter_id NOT IN (SELECT encounter_id FROM has_stem WHERE stem IN (SELECT stem FROM stems WHERE term = 'ques'))""", **STEMS))
def keyword_search_stemmed(spark, d):
    """Texts with a form of "run" or "hand", and none of "que"."""
    from caseflow.operators.postings import stemmed_keys
    return stemmed_keys(_summaries(spark, d), "encounter_id", "summary_text", ["running", "handed"], ["ques"])


def _postings(spark, d):
    """Postings of the summaries, grown in two batches: version 1 of every text first, then what changed."""
    from caseflow.operators.postings import Postings
    from caseflow.session import scratch_path
    p = Postings(spark, scratch_path(spark, "postings"))
    p.add(fx.summaries_src(spark, d).where("version = 1"), "summary_text")
    p.add(_summaries(spark, d), "summary_text")
    return p


@register("keyword_search_postings", fx.with_views(f"""
SELECT DISTINCT encounter_id FROM summaries
WHERE list_has_any({q.terms('summary_text')}, ['thon', 'thor'])
  AND NOT list_has_any({q.terms('summary_text')}, ['que'])""", **SUM))
def keyword_search_postings(spark, d):
    return _postings(spark, d).keys(POS, NEG)


@register("keyword_rank_postings", fx.with_views(f"""
SELECT encounter_id, round(r / (r + 1), 6) AS rank FROM (
  SELECT encounter_id, CAST(len(list_filter({q.tokens('summary_text')}, lambda t: t IN ('thon', 'thor'))) AS DOUBLE) AS r
  FROM summaries
  WHERE list_has_any({q.terms('summary_text')}, ['thon', 'thor'])
    AND NOT list_has_any({q.terms('summary_text')}, ['que']))""", **SUM))
def keyword_rank_postings(spark, d):
    r = F.col("r").cast("double")
    return _postings(spark, d).rank(POS, NEG).select("encounter_id", F.round(r / (r + 1), 6).alias("rank"))


@register("postings_document_frequency", fx.with_views(f"""
SELECT term, count(*) AS doc_freq FROM (SELECT encounter_id, unnest({q.terms('summary_text')}) AS term FROM summaries)
GROUP BY term""", **SUM))
def postings_document_frequency(spark, d):
    return _postings(spark, d).document_frequency()


@register("keyword_negative_only", fx.with_views(f"""
SELECT DISTINCT encounter_id FROM summaries WHERE NOT list_has_any({q.terms('summary_text')}, ['que', 'des'])""", **SUM))
def keyword_negative_only(spark, d):
    return se.keyword_keys(_summaries(spark, d), "summary_text", None, ["que", "des"])


@register("keyword_rank", fx.with_views(f"""
SELECT encounter_id, round(r / (r + 1), 6) AS rank FROM (
  SELECT encounter_id, CAST(len(list_filter({q.tokens('summary_text')}, lambda t: t IN ('thon', 'thor'))) AS DOUBLE) AS r
  FROM summaries
  WHERE list_has_any({q.terms('summary_text')}, ['thon', 'thor'])
    AND NOT list_has_any({q.terms('summary_text')}, ['que']))""", **SUM))
def keyword_rank(spark, d):
    r = se.keyword_rank(_summaries(spark, d), "summary_text", POS, NEG)
    return r.select("encounter_id", F.round("rank", 6).alias("rank"))


@register("keyword_notes_level", fx.with_views(f"""
SELECT DISTINCT encounter_id FROM lines WHERE list_has_any({q.terms('note_text')}, ['thon', 'thor'])""",
    lines=fx.NOTE_LINES_SQL))
def keyword_notes_level(spark, d):
    return se.keyword_keys(fx.note_lines_src(spark, d), "note_text", POS, None)


@register("keyword_narrative_level", fx.with_views(f"""
SELECT DISTINCT encounter_id FROM (
  SELECT encounter_id, string_agg(note_type || chr(10) || chr(10) || note_text, chr(10) || chr(10)
         ORDER BY rank, line, note_text) AS narrative
  FROM (SELECT *, list_position({q.sql_str_list(NARRATIVE_NOTE_ORDER)}, note_type) AS rank
        FROM lines WHERE note_text IS NOT NULL) x
  WHERE rank IS NOT NULL GROUP BY encounter_id)
WHERE list_has_any({q.terms('narrative')}, ['thon', 'thor'])""", lines=fx.NOTE_LINES_SQL))
def keyword_narrative_level(spark, d):
    nar = full_narratives(fx.note_lines_src(spark, d))
    return se.keyword_keys(nar, "full_narrative", POS, None)


@register("term_document_frequency", fx.with_views(f"""
SELECT term, count(*) AS doc_freq FROM (SELECT unnest({q.terms('summary_text')}) AS term FROM summaries) GROUP BY term""",
    **SUM))
def term_document_frequency(spark, d):
    return se.term_document_frequency(_summaries(spark, d), "summary_text")


# ------------------------------------------------------------------ vectors
VEC = dict(vectors=fx.VECTORS_SQL, probe=fx.QUERY_VECTOR_SQL)
TOPK = 100  # below the size of ``embeddings`` at every scale, so that the cut is tested


def _topk_sql(dist_sql: str, order: str = "ASC") -> str:
    return fx.with_views(f"""
SELECT encounter_id, round(distance, 6) + 0.0 AS distance FROM (
  SELECT v.encounter_id, {dist_sql} AS distance FROM vectors v, probe p)
ORDER BY distance {order}, encounter_id LIMIT {TOPK}""", **VEC)


def _topk(metric):
    def run(spark, d):
        r = se.nearest(fx.vectors_src(spark, d), _qvec(spark, d), metric, limit=TOPK)
        return r.select("encounter_id", F.round("distance", 6).alias("distance"))
    return run


register("topk_cosine", _topk_sql(q.cosine_distance("v.vec", "p.qvec")))(_topk("cosine"))
register("topk_l2", _topk_sql(q.l2("v.vec", "p.qvec")))(_topk("L2"))
register("topk_l1", _topk_sql(q.l1("v.vec", "p.qvec")))(_topk("L1"))
register("topk_inner_product", fx.with_views(f"""
SELECT encounter_id, round(-ip, 6) AS distance FROM (
  SELECT v.encounter_id, {q.dot('v.vec', 'p.qvec')} AS ip FROM vectors v, probe p)
ORDER BY ip DESC, encounter_id LIMIT {TOPK}""", **VEC))(_topk("max_inner_product"))


@register("topk_ties", f"""
SELECT vec_id AS encounter_id, CAST(abs(label - 3) AS DOUBLE) AS distance FROM embeddings
ORDER BY abs(label - 3), vec_id LIMIT {TOPK}""")
def topk_ties(spark, d):
    """Many rows at the same distance on both sides of the cut: the smaller keys stay."""
    e = fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("encounter_id"),
                                               F.array(F.col("label").cast("float")).alias("vec"))
    return se.nearest(e, [3.0], "L1", limit=TOPK).select("encounter_id", "distance")


@register("semantic_unbounded", fx.with_views("SELECT 1", **VEC)[:-len("SELECT 1")].rstrip() + f"""
, ranked AS (SELECT encounter_id, similarity,
    sum(similarity) OVER (ORDER BY similarity DESC, encounter_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(similarity) OVER () AS tot, row_number() OVER (ORDER BY similarity DESC, encounter_id) AS rn
  FROM (SELECT v.encounter_id, greatest(0.0, 1.0 - {q.cosine_distance('v.vec', 'p.qvec')}) AS similarity
        FROM vectors v, probe p))
SELECT encounter_id, round(similarity, 6) AS similarity FROM ranked WHERE tot = 0 OR rn = 1 OR cum / tot <= 0.8""")
def semantic_unbounded(spark, d):
    """No top-k and no bypass: every row is ranked and the cutoff acts."""
    r = se.semantic_search(fx.vectors_src(spark, d), _qvec(spark, d), "cosine",
                           cutoff=co.choose("cum_mass", mass=0.8))
    return r.select("encounter_id", F.round("similarity", 6).alias("similarity"))


def _cum_mass_sql(scored: str, mass: float = 0.95) -> str:
    """Oracle for cumulative-mass cut over a scored relation (encounter_id, similarity)."""
    return f"""
, ranked AS (SELECT encounter_id, similarity,
    row_number() OVER (ORDER BY similarity DESC, encounter_id) - 1 AS pos,
    sum(similarity) OVER (ORDER BY similarity DESC, encounter_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(similarity) OVER () AS tot, count(*) OVER () AS n
  FROM {scored})
, idx AS (SELECT sum(CASE WHEN tot = 0 THEN 0 WHEN cum / tot <= {mass} THEN 1 ELSE 0 END) - 1 AS i FROM ranked)
SELECT encounter_id, round(similarity, 6) AS similarity FROM ranked, idx
WHERE n < 300 OR tot = 0 OR pos <= greatest(i, 0)"""


def _knee_sql(scored: str) -> str:
    return f"""
, ranked AS (SELECT encounter_id, similarity,
    row_number() OVER (ORDER BY similarity DESC, encounter_id) - 1 AS pos,
    count(*) OVER () AS n, min(similarity) OVER () AS lo, max(similarity) OVER () AS hi
  FROM {scored})
, normed AS (SELECT *, (similarity - lo) / (hi - lo + 1e-12) AS sn FROM ranked)
, ends AS (SELECT max(CASE WHEN pos = 0 THEN sn END) AS f, max(CASE WHEN pos = n - 1 THEN sn END) AS l FROM normed)
, gaps AS (SELECT normed.*, sn - (f + (l - f) * (CASE WHEN n > 1 THEN pos / (n - 1) ELSE 0.0 END)) AS gap
           FROM normed, ends)
, idx AS (SELECT pos AS i FROM gaps ORDER BY gap DESC, pos LIMIT 1)
SELECT encounter_id, round(similarity, 6) AS similarity FROM gaps, idx WHERE n < 300 OR pos <= i"""


def _sem_scored_sql() -> str:
    return fx.with_views(f"""SELECT 1""", **VEC)[:-len("SELECT 1")].rstrip() + f"""
, scored AS (SELECT encounter_id, d AS distance, greatest(0.0, 1.0 - d) AS similarity FROM (
    SELECT v.encounter_id, {q.cosine_distance('v.vec', 'p.qvec')} AS d FROM vectors v, probe p)
  ORDER BY distance, encounter_id LIMIT 5000)"""


@register("semantic_cosine", _sem_scored_sql() + _cum_mass_sql("scored"))
def semantic_cosine(spark, d):
    r = se.semantic_search(fx.vectors_src(spark, d), _qvec(spark, d), "cosine", SEMANTIC_TOP_K, co.choose("cum_mass"),
                           CUTOFF_BYPASS_ROWS)
    return r.select("encounter_id", F.round("similarity", 6).alias("similarity"))


@register("semantic_knee", _sem_scored_sql() + _knee_sql("scored"))
def semantic_knee(spark, d):
    r = se.semantic_search(fx.vectors_src(spark, d), _qvec(spark, d), "cosine", SEMANTIC_TOP_K, co.choose("elbow"),
                           CUTOFF_BYPASS_ROWS)
    return r.select("encounter_id", F.round("similarity", 6).alias("similarity"))


# Standalone cutoffs over a score list taken from the data: the case-report scores
# (l_tax) of one cut window; W1/W2 run on the descending ranking.
CUT_SRC = "SELECT encounter_id, max(score) AS similarity FROM cases GROUP BY encounter_id"


def _cut_input(spark, d):
    return tb.stored_cases(spark, d).groupBy("encounter_id").agg(F.max("score").alias("similarity"))


@register("cutoff_cumulative_mass", fx.with_views("SELECT 1", cases=fx.CASE_VERSIONS_SQL)[:-len("SELECT 1")].rstrip()
          + f"\n, scored AS ({CUT_SRC})" + _cum_mass_sql("scored").replace("n < 300 OR ", ""))
def cutoff_cumulative_mass(spark, d):
    r = co.cumulative_mass_global(_cut_input(spark, d), "similarity", "encounter_id", 0.95)
    return r.select("encounter_id", F.round("similarity", 6).alias("similarity"))


@register("cutoff_knee", fx.with_views("SELECT 1", cases=fx.CASE_VERSIONS_SQL)[:-len("SELECT 1")].rstrip()
          + f"\n, scored AS ({CUT_SRC})" + _knee_sql("scored").replace("n < 300 OR ", ""))
def cutoff_knee(spark, d):
    r = co.knee_global(_cut_input(spark, d), "similarity", "encounter_id")
    return r.select("encounter_id", F.round("similarity", 6).alias("similarity"))


# ------------------------------------------------------------------ combined
FILTERS = {"encounters": {"ctas": {"lte": 3}}, "unknown": {"a": {"eq": 1}}}


@register("combined_search", (_sem_scored_sql() + _cum_mass_sql("scored").replace(
    "SELECT encounter_id, round(similarity, 6) AS similarity FROM ranked, idx",
    ", sem AS (SELECT encounter_id FROM ranked, idx") + f""")
, kw AS (SELECT DISTINCT encounter_id FROM summaries
         WHERE list_has_any({q.terms('summary_text')}, ['thon', 'thor'])
           AND NOT list_has_any({q.terms('summary_text')}, ['que']))
, flt AS (SELECT encounter_id FROM encounters WHERE ctas <= 3)
SELECT encounter_id FROM kw INTERSECT SELECT encounter_id FROM sem INTERSECT SELECT encounter_id FROM flt""")
          .replace("WITH vectors", "WITH summaries AS (" + fx.LATEST_SUMMARIES_SQL + "), encounters AS ("
                   + tb.ENCOUNTERS_SQL + "), vectors", 1))
def combined_search(spark, d):
    t = stored(spark, d)
    kw = se.keyword_keys(_summaries(spark, d), "summary_text", POS, NEG)
    sem = se.semantic_search(fx.vectors_src(spark, d), _qvec(spark, d), "cosine", SEMANTIC_TOP_K,
                             bypass_below=CUTOFF_BYPASS_ROWS)
    return se.combined_search(kw, sem, t, FILTERS)
