"""The daily batch against its parts computed separately (brute-force style check)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from caseflow.operators import cases as cs
from caseflow.sources import tables as tb
from tests.conftest import SF_SMALL


def test_daily_batch_matches_its_parts(spark):
    rows = {r["encounter_id"]: r for r in E.queries()["pipeline_daily"](spark, SF_SMALL).collect()}
    # the case flag equals the flag computed directly with the learned cutoff
    enc = tb.stored_encounters(spark, SF_SMALL)
    cutoff = cs.dynamic_cutoff(enc, "1998-06-01").first()["cutoff"]
    flags = {r["encounter_id"]: r["is_case"] for r in
             cs.flag_cases(enc.where(F.col("encounter_id").isin(list(rows))), F.lit(cutoff)).collect()}
    assert {k: r["is_case"] for k, r in rows.items()} == flags
    # codes exist exactly for cases, and processed notes are lower-case (de-identified)
    for k, r in rows.items():
        if not r["is_case"]:
            assert r["no1"] is None and r["bp1"] is None and r["disp"] is None
        assert r["processed_notes"] == r["processed_notes"].lower()


def test_daily_batch_stores_chunks_of_its_notes(spark, tmp_path):
    from caseflow.catalog.streams import _batch_sources
    from caseflow.plans.daily import daily_batch
    src = _batch_sources(spark, SF_SMALL)
    t = daily_batch(src, str(tmp_path), "1998-06-01")
    again = daily_batch(src, str(tmp_path), "1998-06-01")
    assert {n: t[n].count() for n in t} == {n: again[n].count() for n in t}
    assert t["chunked_notes"].select("note_id").distinct().count() == t["notes"].count()
    assert t["case_report"].count() == t["flagged"].where("is_case").count() > 0


LINE = ("encounter_id long, note_id long, note_type string, author_type string, author_service string, line int, note_text string")


def _source(spark, sf_dir, keys):
    """Sources of the batch for a few visits, whose lines the tests state themselves."""
    from caseflow.catalog.streams import _batch_sources
    src = _batch_sources(spark, sf_dir)
    return {**src, **{n: src[n].where(F.col("encounter_id").isin(keys)) for n in ("visits", "problem_lists", "referrals", "answers")}}


def _lines(spark, rows):
    return spark.createDataFrame([(e, n, t, "MD", "ER", i, x) for e, n, t, i, x in rows], LINE)


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_late_lines_reach_every_table(spark, tmp_path):
    from caseflow.plans.daily import TABLES, current, daily_batch
    src = _source(spark, SF_SMALL, [0, 1, 2, 3])
    p, c = "ED Provider Notes", "Consults"
    day1 = [(1, 10, p, 1, "Fell off the bike."), (2, 20, p, 1, "Burn of the hand."), (2, 20, p, 1, "Burn of the hand."), (3, None, p, 1, None)]
    day2 = [(1, 10, p, 2, "Wrist is broken."), (1, 11, c, 1, "Consults asked."), (3, 30, p, 1, "Cut by glass."), (2, 20, p, 1, "Burn of the hand.")]
    run = lambda day: daily_batch({**src, "lines": _lines(spark, day)}, str(tmp_path / "late"), "1998-06-01")
    t = run(day1)
    assert _rows(t["notes"].where("note_id > 0"), "note_id", "note_text") == [(10, "Fell off the bike."), (20, "Burn of the hand.")]
    assert 3 not in {r[0] for r in _rows(t["encounters"], "encounter_id")}  # no text yet
    first = dict(_rows(t["processed_notes"], "encounter_id", "vec"))
    t = run(day2)
    assert _rows(t["notes"].where("note_id > 0"), "note_id", "note_text") == [
        (10, "Fell off the bike. Wrist is broken."), (11, "Consults asked."), (20, "Burn of the hand."), (30, "Cut by glass.")]
    texts = dict(_rows(t["encounters"], "encounter_id", "full_narrative"))
    assert "Wrist is broken." in texts[1] and "Consults asked." in texts[1] and "Cut by glass." in texts[3] and len(texts) == 3
    processed = dict(_rows(t["processed_notes"], "encounter_id", "note_text"))
    assert "wrist is broken" in processed[1] and processed[2].count("burn") == 2  # a line that one export holds twice
    vec = dict(_rows(t["processed_notes"], "encounter_id", "vec"))
    assert vec[2] == first[2] and vec[1] != first[1]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 and len(v) == 1024 for v in vec.values())
    chunks = " ".join(x for _, x in _rows(t["chunked_notes"], "chunk_id", "chunk_text"))
    assert chunks.count("Wrist is broken.") == 1 and chunks.count("Fell off the bike.") == 1
    # both days once more, in order: no table changes
    state = lambda t: {n: sorted(map(repr, t[n].drop("vec").collect())) for n in TABLES}
    want = state(t)
    run(day1)
    assert state(run(day2)) == want
    # and all lines at once give the same latest rows
    once = daily_batch({**src, "lines": _lines(spark, day1[:1] + day1[3:] + day2 + day2[3:])}, str(tmp_path / "once"), "1998-06-01")
    a, b = current(t), current(once)
    for n in ("encounters", "notes", "processed_notes", "chunked_notes", "problems", "referrals", "summaries", "case_report"):
        cols = [x for x in a[n].columns if x not in ("vec", "version")]
        assert _rows(a[n].select([F.col(x).cast("string") for x in cols]).na.fill("-"), *cols) == \
            _rows(b[n].select([F.col(x).cast("string") for x in cols]).na.fill("-"), *cols), n


def test_changed_answers_are_new_versions(spark, tmp_path):
    from caseflow.plans.daily import daily_batch
    src = _source(spark, SF_SMALL, [1, 2])
    src["lines"] = _lines(spark, [(1, 10, "ED Provider Notes", 1, "Fell."), (2, 20, "ED Provider Notes", 1, "Burn.")])
    daily_batch(src, str(tmp_path), "1998-06-01")
    text = F.when(F.col("encounter_id") == 1, F.lit("a new summary of the fall")).otherwise(F.col("summary_text"))
    t = daily_batch({**src, "answers": src["answers"].withColumn("summary_text", text)}, str(tmp_path), "1998-06-01")
    assert [r[:2] for r in _rows(t["summaries"], "encounter_id", "version")] == [(1, 1), (1, 2), (2, 1)]
    got = t["summaries"].where("encounter_id = 1 AND version = 2").first()
    assert got.summary_text == "a new summary of the fall" and got.vec == pytest.approx(
        __import__("caseflow.operators.embed", fromlist=["x"]).embed_query(got.summary_text), abs=1e-6)


def test_batch_tables_feed_exports_reports_and_searches(spark, tmp_path):
    from caseflow.catalog.streams import _batch_sources
    from caseflow.plans.daily import daily_batch
    from caseflow.plans.export import raw_export
    from caseflow.plans.query import run_query
    from caseflow.plans.report import report_by_date
    t = daily_batch(_batch_sources(spark, SF_SMALL), str(tmp_path), "1998-06-01", grain="month")
    n = t["encounters"].count()
    out = raw_export(t, start="1990-01-01", end="2005-01-01")
    assert out.select("encounter_id").distinct().count() == n and out.where("city IS NULL OR address IS NULL").count() == 0
    assert report_by_date(t, "1990-01-01", "2005-01-01").count() == n
    texts = dict(_rows(t["processed_notes"], "encounter_id", "note_text"))
    key = max(texts, key=lambda k: len(texts[k]))
    for level, text in ((2, texts[key]), (1, t["summaries"].where(F.col("encounter_id") == key).first().summary_text),
                        (3, t["chunked_notes"].join(t["notes"].where(F.col("encounter_id") == key).select("note_id"), "note_id").first().chunk_text)):
        query = {"semantic": {"description": text, "detail_level": level, "limit": 1}}
        hit = run_query(t, query, unit=True).collect()
        assert len(hit) == 1 and (level != 2 or hit[0].encounter_id == key)
        plain = run_query(t, query).collect()
        assert [r.encounter_id for r in hit] == [r.encounter_id for r in plain]


def test_batch_reads_intent_and_grows_postings(spark, tmp_path):
    from caseflow.operators import scoring as so
    from caseflow.operators.postings import Postings
    from caseflow.plans.daily import daily_batch
    from caseflow.plans.query import search_keys
    src = _source(spark, SF_SMALL, [0, 1, 2, 3])
    flagged = src["visits"].withColumn("score", F.lit(1.0))  # every visit is a case
    src["visits"], src["history"] = flagged.withColumn("diagnosis", F.lit("Sprain of ankle")), src["history"].where("encounter_id = 0")
    p = "ED Provider Notes"
    day1 = _lines(spark, [(1, 10, p, 1, "Fell off the ladder."), (2, 20, p, 1, "Punched in a fight.")])
    day2 = _lines(spark, [(1, 10, p, 2, "Then punched in a fight, punched twice, a fight.")])
    learn = spark.createDataFrame([(f"fell off the ladder {i}", 10) for i in range(9)] + [(f"punched in a fight {i}", 11) for i in range(9)],
                                  "text string, intent int")
    model = so.fit_classes(learn, "text", "intent", num_features=1 << 10)
    made = {n: Postings(spark, str(tmp_path / n)) for n in ("encounters", "summaries")}
    run = lambda day: daily_batch({**src, "lines": day}, str(tmp_path / "t"), "1998-06-01", intent_model=model, postings=made)
    words = lambda level, **w: sorted(r[0] for r in search_keys(t, {"keywords": {"detail_level": level, **w}}, postings=made).collect())
    t = run(day1)
    assert _rows(t["case_report"], "encounter_id", "version", "intent") == [(1, 1, 10), (2, 1, 11)]
    assert words(2, positive=["ladder"]) == [1] and words(2, positive=["fight"]) == [2] and words(2, negative=["fight"]) == [1]
    t = run(day2)
    latest = {r[0]: r[2] for r in _rows(t["case_report"], "encounter_id", "version", "intent")}
    assert latest == {1: latest[1], 2: 11} and latest[1] != 10  # the narrative now tells of both
    for spec in ({"positive": ["ladder"]}, {"positive": ["fight"]}, {"negative": ["twice"]}, {"positive": ["fight"], "negative": ["ladder"]}):
        for level in (1, 2):
            plain = sorted(r[0] for r in search_keys(t, {"keywords": {"detail_level": level, **spec}}).collect())
            assert words(level, **spec) == plain, (level, spec)
    assert words(2, positive=["fight"]) == [1, 2] and words(2, negative=["twice"]) == [2]
    plan = search_keys(t, {"keywords": {"detail_level": 2, "positive": ["fight"]}}, postings=made)._jdf.queryExecution().toString()
    assert "full_narrative" not in plan  # no text is read
    # the tables read back under their declared schemas
    from caseflow.sources.schemas import STORED
    from caseflow.sources.tables import read_stored
    back = read_stored(spark, str(tmp_path / "t"), every_file=True)
    assert set(back) == set(STORED)
    for n in back:
        assert sorted(back[n].dtypes) == sorted(t[n].dtypes) and back[n].count() == t[n].count(), n


def test_answers_are_cut_down_before_they_are_parsed(spark):
    """The keys of a batch meet the table that the answers come from, not the parsed answers of all visits."""
    from caseflow.catalog.streams import _batch_sources
    from caseflow.sources import sinks as sk
    keys = sk.small_keys(spark.createDataFrame([(1,), (2,)], "encounter_id long"), "encounter_id")
    few = _batch_sources(spark, SF_SMALL)["answers"].join(keys, "encounter_id", "left_semi")
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Aggregate") < plan.index("Generate") < plan.index("LeftSemi")
    assert sorted(r[0] for r in few.select("encounter_id").collect()) == [1, 2]
