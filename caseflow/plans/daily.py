"""The daily batch: from note lines to stored tables (P1).

The batch is the visits that have note lines. Tables that are worked out from a visit's lines
(encounters, notes, processed notes, chunks) are partitioned by the day (or month) of arrival. The lines
themselves are stored too, one row per distinct line: a line that comes on a later day is told by its
hash, the visit's tables are worked out again from all its lines, and the partitions of the touched days
are rewritten. Summaries and case reports are versioned: what differs from the stored latest version is
appended one version higher. Subjects, problems and referrals take only keys they do not hold yet.

Lines are stored last. A run that fails before is run again from the start and ends in the same tables; a
run whose lines are all stored touches nothing. Every text that a search by meaning can ask for is stored
with its vector, of unit length; a text that has not changed keeps the vector it has.

What several tables need is written once and read back. Tables that do not depend on each other are
written by concurrent jobs.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators import cases as cs
from caseflow.operators import deid as dd
from caseflow.operators import embed as em
from caseflow.operators import scoring
from caseflow.operators import sections as sc
from caseflow.operators.versions import latest_version
from caseflow.plans import entities as en
from caseflow.plans import notes as nt
from caseflow.sources import sinks as sk

KEY, PART = "encounter_id", "arrival_part"
GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
TABLES = ["subjects", "encounters", "note_lines", "notes", "chunked_notes", "processed_notes", "problems",
          "referrals", "summaries", "case_report"]


def line_hash(cols: list[str]):
    """A 64-bit name of a line among those of its visit; nulls count."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in cols])


def daily_batch(src: dict[str, DataFrame], root: str, batch_date: str, grain: str = "day", jobs: int = 4,
                intent_model=None, postings: dict | None = None) -> dict[str, DataFrame]:
    """Run one batch into the tables under ``root``; the stored tables as they are then.

    ``src``: lines, visits, subjects (with name), problem_lists, referrals, answers (parsed model
    answers with intent and summary), history (stored encounters, for the cutoff). ``grain`` is the
    calendar period of a partition, ``jobs`` how many tables are written at a time. With an
    ``intent_model`` (see ``operators/scoring``) the intent is read from the narrative instead of the
    answers. ``postings`` holds the stored ``Postings`` that the batch grows: of "encounters" (narratives)
    and "summaries" (latest versions), either or both."""
    postings = postings or {}
    lines = src["lines"]
    spark = lines.sparkSession
    at = lambda name: os.path.join(root, name)
    scratch: list[str] = []
    keep = lambda df, name: sk.roundtrip(spark, df, name, scratch=scratch)
    out: dict[str, DataFrame] = {}
    cols = lines.columns

    # the batch: its distinct lines with how often each occurs, and its visits with their partition
    counted = keep(lines.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")), "batch_lines")
    keys = sk.small_keys(counted, KEY)
    visits = src["visits"].join(keys, KEY, "left_semi").withColumn(
        PART, F.coalesce(F.date_format("arrival_date", GRAINS[grain]), F.lit("none")))
    if sk.table_exists(spark, at("encounters")):  # a visit stays in the partition it was stored in
        held = spark.read.schema(visits.select(KEY, PART).schema).parquet(at("encounters")).withColumnRenamed(PART, "_held")
        visits = visits.join(held.join(keys, KEY, "left_semi"), KEY, "left").withColumn(PART, F.coalesce("_held", PART)).drop("_held")
    visits = keep(visits, "batch_visits")
    place = visits.groupBy(KEY).agg(F.min(PART).alias(PART))
    parts = [r[0] for r in place.select(PART).distinct().collect()]  # calendar periods
    subjects = src["subjects"].join(sk.small_keys(visits, "subject_id"), "subject_id", "left_semi")
    names = visits.select(KEY, "subject_id").join(subjects.select("subject_id", "subject_name"), "subject_id")
    two = dd.check_single_name(names)
    if not two.isEmpty():
        raise ValueError("a visit carries more than one subject name")

    # lines that are not stored yet, and all lines of the visits they touch
    fresh = counted.join(place, KEY).withColumn("line_hash", line_hash(cols))
    stored = sk.stored_rows(spark, fresh, at("note_lines"), PART, parts)
    if stored is None:
        new, touched_lines = fresh, counted.join(place.select(KEY), KEY, "left_semi")
    else:
        stored = stored.join(keys, KEY, "left_semi")
        have = stored.groupBy(KEY, "line_hash").agg(F.max("copies").alias("_have"))
        new = keep(fresh.join(have, [KEY, "line_hash"], "left").where("_have IS NULL OR _have < copies").drop("_have"), "new_lines")
        both = stored.select(*cols, "copies").unionByName(fresh.select(*cols, "copies"))
        touched_lines = both.join(sk.small_keys(new, KEY), KEY, "left_semi").groupBy(*cols).agg(F.max("copies").alias("copies"))
    mine_lines = keep(touched_lines.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*cols), "touched_lines")
    touched = sk.small_keys(mine_lines, KEY)

    out["subjects"] = sk.append_new(spark, en.build_subjects(visits, subjects), at("subjects"), "subject_id")
    built = en.build_encounters(visits.join(touched, KEY, "left_semi"), subjects, mine_lines).withColumn(
        "arrival_ts", F.col("arrival_date").cast("timestamp"))
    out["encounters"] = sk.rewrite(spark, built.join(place, KEY), at("encounters"), KEY, PART, scratch)
    kept = out["encounters"].where(F.col(PART).isin(parts)).join(keys, KEY, "left_semi")
    mine = keep(kept.join(out["subjects"].select("subject_id").join(sk.small_keys(visits, "subject_id"), "subject_id", "left_semi"),
                          "subject_id", "left_semi"), "batch_encounters")
    owner = mine.select(KEY, PART)
    few = sk.small_keys(mine, KEY)  # the sources are cut down to these before anything is worked out from them

    def child(df: DataFrame) -> DataFrame:
        return df.join(owner, KEY)

    def rewritten(name: str, rows: DataFrame, key: str, text: str | None = None, dim: int = 0, of: str = KEY) -> None:
        """Rows of the touched visits into table ``name``; all rows of one ``of`` are replaced."""
        if text:
            like = em.with_vectors(rows.limit(0), key, text, dim)
            stored = sk.stored_rows(spark, like, at(name), PART, parts)
            rows = em.keep_vectors(keep(rows, name), stored, key, text, dim)
        out[name] = sk.rewrite(spark, rows, at(name), of, PART, scratch)

    def processed():
        text = dd.deidentify(sc.filter_sections(nt.merge_note_lines(mine_lines), "note_text"), names.select(KEY, "subject_name"))
        rewritten("processed_notes", child(text), KEY, "note_text", em.LARGE_DIM)

    def notes():
        rows = keep(child(nt.merge_note_ids(mine_lines)), "batch_notes")
        rewritten("notes", rows, "note_id")
        chunks = em.chunk_by_size(rows, "note_id", "note_text").withColumn("chunk_id", F.concat_ws("-", "note_id", "chunk_number"))
        rewritten("chunked_notes", chunks.join(rows.select("note_id", PART), "note_id"), "chunk_id", "chunk_text", em.SMALL_DIM, "note_id")

    def problems():
        rows = keep(en.build_problems(src["problem_lists"].join(few, KEY, "left_semi")).withColumn("id", F.concat_ws("|", KEY, "problem")).join(owner, KEY), "batch_problems")
        out["problems"] = sk.append_new(spark, rows, at("problems"), "id", PART, parts)

    def referrals():
        rows = keep(en.build_referrals(src["referrals"].join(few, KEY, "left_semi")).withColumn("id", F.concat_ws("|", KEY, "referral")).join(owner, KEY), "batch_referrals")
        out["referrals"] = sk.append_new(spark, rows, at("referrals"), "id", PART, parts)

    def answered():
        answers = src["answers"].join(few, KEY, "left_semi")
        if intent_model is not None:
            found = scoring.predict_classes(intent_model, mine, KEY, "full_narrative").select(KEY, "intent")
            answers = answers.drop("intent").join(found, KEY, "left")
        answers = keep(answers, "batch_answers")
        out["summaries"] = sk.append_versions(spark, en.build_summaries(answers), at("summaries"), KEY, ["summary_text"],
                                              lambda df: em.with_vectors(df, KEY, "summary_text", em.LARGE_DIM))
        if "summaries" in postings:
            latest = latest_version(out["summaries"].select(KEY, "summary_text", "version").join(keys, KEY, "left_semi"))
            postings["summaries"].add(latest, "summary_text")
        cutoff = cs.dynamic_cutoff(src["history"], batch_date).first()["cutoff"]
        out["flagged"] = sk.roundtrip(spark, cs.flag_cases(mine, F.lit(cutoff)), "batch_flagged")
        remarks = mine.select(KEY, F.col("notes").alias("remark"))
        cases = keep(cs.build_cases(out["flagged"], answers, mine, remarks), "batch_cases")
        compare = [c for c in cases.columns if c not in (KEY, "version")]
        out["case_report"] = sk.append_versions(spark, cases, at("case_report"), KEY, compare)

    def narratives():
        if "encounters" in postings:
            postings["encounters"].add(mine, "full_narrative")

    with ThreadPoolExecutor(max_workers=jobs) as pool:
        for done in [pool.submit(f) for f in (notes, processed, answered, problems, referrals, narratives)]:
            done.result()

    new.select(*fresh.columns).hint("rebalance", F.col(PART)).write.mode("append").partitionBy(PART).parquet(at("note_lines"))
    out["note_lines"] = spark.read.schema(fresh.schema).parquet(at("note_lines"))
    sk.discard(spark, scratch)
    return out


def current(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a batch with the latest version only of versioned ones."""
    return {n: latest_version(t) if "version" in t.columns else t for n, t in tables.items()}
