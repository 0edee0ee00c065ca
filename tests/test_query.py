"""Query dicts: errors, empty criteria, and the query vector."""

import pytest

from caseflow.operators import embed as em
from caseflow.plans import query as qy


@pytest.fixture(scope="module")
def tables(spark):
    e = spark.createDataFrame([(1, "fell on ice", 1), (2, "burn", 2)], "encounter_id long, full_narrative string, ctas int")
    s = spark.createDataFrame([(1, "old burn text", 1, [1.0, 0.0]), (1, "slipped on ice", 2, [1.0, 0.0]), (2, "burn of hand", 1, [0.0, 1.0])],
                              "encounter_id long, summary_text string, version int, vec array<double>")
    c = spark.createDataFrame([(2,)], "encounter_id long")
    return {"encounters": e, "summaries": s, "case_report": c}


def keys(df):
    return sorted(r["encounter_id"] for r in df.collect())


def test_only_the_latest_summary_counts(tables):
    assert keys(qy.search_keys(tables, {"keywords": {"positive": ["burn"]}})) == [2]
    assert keys(qy.search_keys(tables, {"keywords": {"positive": ["ice"], "detail_level": 2}})) == [1]


def test_parts_are_intersected(tables):
    query = {"keywords": {"positive": ["burn", "ice"]}, "filters": {"encounters": {"ctas": {"lte": 1}}}}
    assert keys(qy.search_keys(tables, query)) == [1]
    sem = {"semantic": {"description": "x", "limit": 1}}
    assert keys(qy.search_keys(tables, sem, embed=lambda text, small: [0.0, 1.0])) == [2]


def test_no_criteria_finds_nothing(tables):
    assert keys(qy.search_keys(tables, {})) == []
    assert keys(qy.search_keys(tables, {"keywords": {"positive": [], "negative": []}})) == []


@pytest.mark.parametrize("query", [
    {"keywords": {"positive": ["a"], "detail_level": 4}}, {"semantic": {"description": "a", "detail_level": 0}},
    {"semantic": {"description": "a", "metric": "hamming"}}, {"surprise": {}},
    {"keywords": {"positive": ["burn"]}, "rerank": {"prompt": "burn", "detail_level": 9}}])
def test_bad_queries_are_errors(tables, query):
    with pytest.raises(ValueError):
        qy.search_keys(tables, query, embed=lambda text, small: [0.0, 1.0])


def test_query_vector_equals_the_stored_one(spark):
    text = "Fell off the monkey bars, fell again"
    for dim, small in ((em.SMALL_DIM, True), (em.LARGE_DIM, False)):
        vec = em.dense_embed(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", dim).first()["vec"]
        assert len(vec) == dim and all(abs(a - b) < 1e-9 for a, b in zip(vec, em.embed_query(text, small)))
