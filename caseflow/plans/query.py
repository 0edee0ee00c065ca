"""A search given as one dict, compiled to a plan: keywords, meaning, filters, rerank, report.

    {"keywords": {"positive": [...], "negative": [...], "detail_level": 1},
     "semantic": {"description": "...", "detail_level": 1, "metric": "cosine", "limit": 5000},
     "filters": {"encounters": {"ctas": {"lte": 3}}, "case_report": {"intent": {"eq": 10}}},
     "rerank": {"prompt": "...", "detail_level": 1}}

Every part is optional. Detail levels choose what is searched: for keywords 1 summaries, 2 full
narratives, 3 notes; for meaning 1 summaries, 2 processed notes, 3 note chunks; for the
rerank 1 summaries, 2 processed notes, 3 full narratives. Of summaries, the latest version
counts. An unknown level or metric is an error; a query without criteria finds nothing. Key
sets stay DataFrames throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators import cutoffs as co
from caseflow.operators import embed as em
from caseflow.operators import search as se
from caseflow.operators.versions import latest_version
from caseflow.plans import report as rp

KEY = "encounter_id"
KEYWORD_LEVELS = {1: ("summaries", "summary_text"), 2: ("encounters", "full_narrative"), 3: ("notes", "note_text")}
RERANK_LEVELS = {1: ("summaries", "summary_text"), 2: ("processed_notes", "note_text"), 3: ("encounters", "full_narrative")}
SEMANTIC_LEVELS = {1: "summaries", 2: "processed_notes", 3: "chunked_notes"}
METRICS = ("cosine", "L2", "L1", "max_inner_product")


def _level(levels: dict, level, what: str):
    if level not in levels:
        raise ValueError(f"unknown {what} detail level {level!r}; one of {sorted(levels)}")
    return levels[level]


def _table(tables: dict[str, DataFrame], name: str) -> DataFrame:
    t = tables[name]
    return latest_version(t) if name == "summaries" else t


def keyword_keys(tables: dict[str, DataFrame], spec: dict, postings: dict | None = None) -> DataFrame | None:
    """Keys of a keyword part; None if it names no keyword (it then does not restrict). A level whose
    table has ``postings`` is answered from those and reads no text."""
    name, col = _level(KEYWORD_LEVELS, spec.get("detail_level", 1), "keyword")
    pos, neg = spec.get("positive"), spec.get("negative")
    if not (pos or neg):
        return None
    if name in (postings or {}):
        return postings[name].keys(pos, neg)
    return se.keyword_keys(_table(tables, name), col, pos, neg)


def semantic_keys(tables: dict[str, DataFrame], spec: dict, embed: Callable, cutoff: Callable | None,
                  bypass_below: int, unit: bool = False) -> DataFrame:
    """Keys of a meaning part. ``embed(text, small)`` turns the description into a vector of
    the length the level's table holds (small for chunks); ``unit``: stored vectors have unit length."""
    level = spec.get("detail_level", 1)
    name = _level(SEMANTIC_LEVELS, level, "semantic")
    metric = spec.get("metric", "cosine")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    vec = embed(spec["description"], level == 3)
    if level == 3:
        return se.chunk_semantic_search(tables[name], tables["notes"], vec, metric, spec.get("limit"), cutoff, bypass_below, unit)
    return se.semantic_search(_table(tables, name), vec, metric, spec.get("limit"), cutoff, bypass_below, unit=unit)


def rerank_keys(tables: dict[str, DataFrame], keys: DataFrame, spec: dict, relevance: Callable) -> DataFrame:
    """The candidates ordered by ``relevance(texts, text column, prompt)`` and cut at their mass."""
    name, col = _level(RERANK_LEVELS, spec.get("detail_level", 1), "rerank")
    texts = _table(tables, name).join(keys.select(KEY), KEY, "left_semi").select(KEY, col)
    scored = relevance(texts, col, spec["prompt"]).select(KEY, F.col("relevance").alias("similarity"))
    return co.cumulative_mass_global(scored, "similarity", KEY, inclusive=False).select(KEY)


def search_keys(tables: dict[str, DataFrame], query: dict, embed: Callable | None = None, cutoff: Callable | None = None,
                bypass_below: int = 0, cases_only: bool = False, relevance: Callable = em.overlap_relevance,
                unit: bool = False, postings: dict | None = None) -> DataFrame:
    """The keys that a query dict finds. ``unit`` for the tables of the daily batch, whose vectors have unit length;
    ``postings`` by table name, as the batch grows them."""
    unknown = set(query) - {"keywords", "semantic", "filters", "rerank"}
    if unknown:
        raise ValueError(f"unknown parts of a query: {sorted(unknown)}")
    kw = keyword_keys(tables, query["keywords"], postings) if query.get("keywords") else None
    sem = (semantic_keys(tables, query["semantic"], embed or em.embed_query, cutoff, bypass_below, unit)
           if query.get("semantic") else None)
    keys = se.combined_search(kw, sem, tables, query.get("filters"), tables["case_report"] if cases_only else None)
    if keys is None:
        return tables["encounters"].select(KEY).limit(0)
    return rerank_keys(tables, keys, query["rerank"], relevance) if query.get("rerank") else keys


def run_query(tables: dict[str, DataFrame], query: dict, **options) -> DataFrame:
    """The two-part report of what a query dict finds."""
    return rp.report_by_keys(tables, search_keys(tables, query, **options))
