"""Keyword, vector and combined search over the stored tables; results are key sets
(DataFrames of ``encounter_id``) that never leave the cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as tx
from caseflow.functions import vectors as vx
from caseflow.operators import cutoffs as co
from caseflow.operators import filters as flt

KEY = "encounter_id"


def _norm_terms(words) -> list[str]:
    """Query words → lower-case terms, stop words dropped (as for the texts)."""
    import re
    from caseflow.rules.stopwords import ENGLISH_STOP_WORDS
    stop = set(ENGLISH_STOP_WORDS)
    out = {t for w in words or [] for t in re.findall(r"[a-z0-9]+", str(w).lower()) if t not in stop}
    return sorted(out)


def _raw_tokens(text_col: str):
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"), 0)


def with_terms(df: DataFrame, text_col: str, out: str = "terms") -> DataFrame:
    return df.withColumn(out, tx.search_terms(F.col(text_col)))


def keyword_match(df: DataFrame, text_col: str, positive=None, negative=None) -> DataFrame:
    """Rows whose text has any positive term and none of the negative terms.

    With only negatives, rows free of all of them; with neither, nothing.
    """
    pos, neg = _norm_terms(positive), _norm_terms(negative)
    if not pos and not neg:
        return df.limit(0)
    # Query terms hold no stop words, so overlap with the raw tokens equals overlap
    # with the stop-word-free term set; the tokens are extracted once per row.
    staged = df.withColumn("_tok", _raw_tokens(text_col))
    cond = F.lit(True)
    if pos:
        cond = cond & F.arrays_overlap("_tok", F.array(*[F.lit(t) for t in pos]))
    if neg:
        cond = cond & ~F.arrays_overlap("_tok", F.array(*[F.lit(t) for t in neg]))
    return staged.where(F.coalesce(cond, F.lit(False)))


def keyword_keys(df: DataFrame, text_col: str, positive=None, negative=None) -> DataFrame:
    return keyword_match(df.select(KEY, text_col), text_col, positive, negative).select(KEY).distinct()


def keyword_rank(df: DataFrame, text_col: str, positive=None, negative=None) -> DataFrame:
    """Matches with a relevance in [0, 1): r / (r + 1), r = summed frequency of the
    positive terms in the text."""
    pos = _norm_terms(positive)
    m = keyword_match(df.select(KEY, text_col), text_col, positive, negative)
    posarr = F.array(*[F.lit(t) for t in pos]) if pos else F.array().cast("array<string>")
    r = F.size(F.filter("_tok", lambda t: F.array_contains(posarr, t))).cast("double")
    return m.select(KEY, (r / (r + 1)).alias("rank"))


def term_document_frequency(df: DataFrame, text_col: str) -> DataFrame:
    """Postings summary: for each term, the number of rows containing it."""
    from caseflow.rules.stopwords import ENGLISH_STOP_WORDS
    terms = F.array_distinct(_raw_tokens(text_col))
    return (df.select(F.explode(terms).alias("term")).where(~F.col("term").isin(ENGLISH_STOP_WORDS))
            .groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq")))


# ------------------------------------------------------------------ vectors
def nearest(vectors: DataFrame, qvec: list[float], metric: str = "cosine", *, limit: int,
            vec_col: str = "vec", key: str = KEY) -> DataFrame:
    """Exact top-k by distance (nearest first), ties by key: a TakeOrderedAndProject,
    i.e. a per-partition top-k followed by one bounded merge."""
    q = F.array(*[F.lit(float(x)) for x in qvec])
    dist, sim = vx.metric_columns(metric, F.col(vec_col), q)
    scored = vectors.select(key, dist.alias("distance"), sim.alias("similarity"))
    return scored.orderBy(F.col("distance").asc(), F.col(key).asc()).limit(limit)


def _metric(metric: str, vec_col: str, qvec: list[float], unit: bool):
    if unit:
        return vx.unit_metric_columns(metric, F.col(vec_col), qvec)
    return vx.metric_columns(metric, F.col(vec_col), F.array(*[F.lit(float(x)) for x in qvec]))


def semantic_search(vectors: DataFrame, qvec: list[float], metric: str = "cosine",
                    limit: int | None = None, cutoff: Callable | None = None,
                    bypass_below: int = 0, key: str = KEY, vec_col: str = "vec", unit: bool = False) -> DataFrame:
    """Neighbours, then the automatic cutoff on descending similarity. ``limit`` keeps the
    nearest k first, ``bypass_below`` keeps a shorter hit list whole; unset, every row is
    ranked and the cutoff always acts. ``unit`` states that stored vectors have unit length."""
    dist, sim = _metric(metric, vec_col, qvec, unit)
    scored = vectors.select(key, dist.alias("distance"), sim.alias("similarity"))
    return _cut_scored(scored, limit, cutoff, bypass_below, key)


def chunk_semantic_search(chunks: DataFrame, notes: DataFrame, qvec: list[float], metric: str = "cosine",
                          limit: int | None = None, cutoff: Callable | None = None,
                          bypass_below: int = 0, unit: bool = False) -> DataFrame:
    """Chunk-level search: chunks joined to their note's encounter, best (smallest)
    distance per encounter, then the same cut as ``semantic_search``."""
    dist, sim = _metric(metric, "vec", qvec, unit)
    per_chunk = chunks.select("note_id", dist.alias("distance"), sim.alias("similarity"))
    per_enc = (per_chunk.join(notes.select("note_id", KEY), "note_id", "inner")
               .groupBy(KEY).agg(F.min("distance").alias("distance"), F.max("similarity").alias("similarity")))
    return _cut_scored(per_enc, limit, cutoff, bypass_below)


def _cut_scored(scored: DataFrame, limit: int | None, cutoff: Callable | None,
                bypass_below: int = 0, key: str = KEY) -> DataFrame:
    """Top-k of a scored key set, then the cutoff unless fewer than ``bypass_below`` hits.

    With a limit, the top-k runs once (a per-partition top-k and one bounded merge), and
    the bypass test is a count over the same window pass as the cutoff, so the scan is not
    repeated. Without one the ranking has no bound and the cutoff's distributed form is used."""
    cutoff = cutoff or co.choose("cum_mass")
    if limit is None:
        cut = co.unbounded(cutoff)(scored, score="similarity", tie=key).select(key, "distance", "similarity")
        return cut if not bypass_below else scored.where(scored.agg(F.count(F.lit(1))).scalar() < bypass_below).select(
            key, "distance", "similarity").unionByName(cut).distinct()
    top = scored.orderBy(F.col("distance").asc(), F.col(key).asc()).limit(limit)
    return cutoff(top, score="similarity", tie=key, bypass_below=bypass_below).select(key, "distance", "similarity")


# ------------------------------------------------------------------ combined
def combined_search(keyword_hits: DataFrame | None, semantic_hits: DataFrame | None,
                    tables: dict[str, DataFrame] | None = None, filters: dict | None = None,
                    cases: DataFrame | None = None, key: str = KEY) -> DataFrame | None:
    """Intersection of the keyword, semantic and structured-filter key sets.

    An absent criterion does not restrict; with no criterion at all the result is
    empty (None). Filtered tables are restricted to keys present in ``cases`` when given.
    """
    result = None
    for part in (keyword_hits, semantic_hits):
        if part is None:
            continue
        part = part.select(key).distinct()
        result = part if result is None else result.join(part, key, "left_semi")
    if filters:
        fk = flt.filter_key_sets(tables or {}, filters, key, restrict_to=cases)
        if fk is not None:
            result = fk if result is None else result.join(fk, key, "left_semi")
    return result
