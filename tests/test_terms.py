"""Stems by hand and by a plain version of the rules; postings against a scan of the texts."""

import re
from collections import Counter

import pytest

from caseflow.functions.stems import stem_table
from caseflow.operators import postings as po
from caseflow.operators import search as se
from caseflow.rules import stems as R

# expected stems of the published rules, by hand
STEMS = {"fractures": "fractur", "fracture": "fractur", "fractured": "fractur", "fracturing": "fractur", "burns": "burn", "burned": "burn",
         "burning": "burn", "falling": "fall", "fell": "fell", "hopping": "hop", "hoped": "hope", "hoping": "hope", "ties": "tie", "cries": "cri",
         "cry": "cri", "by": "by", "say": "say", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre", "feed": "feed",
         "relational": "relat", "conditional": "condit", "generalization": "general", "generate": "generat", "community": "communiti",
         "hopefulness": "hope", "happily": "happili", "happy": "happi", "adjustment": "adjust", "replacement": "replac", "adoption": "adopt",
         "controll": "control", "roll": "roll", "rate": "rate", "cease": "ceas", "dying": "die", "news": "news", "inning": "inning",
         "proceed": "proceed", "caresses": "caress", "sprained": "sprain", "lacerations": "lacer", "injuries": "injuri", "injury": "injuri",
         "beautiful": "beauti", "enjoy": "enjoy", "boy": "boy", "yes": "yes", "youth": "youth", "sensibly": "sensibl", "mr2": "mr2", "x": "x",
         "triplicate": "triplic", "electrical": "electr", "formative": "format", "luxuriated": "luxuri", "trying": "tri", "bed": "bed", "shed": "shed"}


def plain_stem(word):
    """The rules, step by step on one word."""
    if len(word) < 3 or word in R.SPECIAL:
        return R.SPECIAL.get(word, word)
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    v = "aeiouy"

    def region(x):
        for i in range(1, len(x)):
            if x[i] not in v and x[i - 1] in v:
                return i + 1
        return len(x)
    r1 = next((len(p) for p in R.REGION_PREFIXES if w.startswith(p)), None) or region(w)
    r2 = r1 + region(w[r1:])

    def short(x):
        return (len(x) >= 3 and x[-3] not in v and x[-2] in v and x[-1] not in v + "wxY") or (len(x) == 2 and x[0] in v and x[1] not in v)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ies", "ied")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in v for c in w[:-2]):
        w = w[:-1]
    if w in R.KEPT_AFTER_PLURAL:
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            base = w[:-len(s)]
            if s in ("eed", "eedly"):
                w = base + "ee" if len(base) >= r1 else w
            elif any(c in v for c in base):
                if base.endswith(("at", "bl", "iz")):
                    w = base + "e"
                elif base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                    w = base[:-1]
                else:
                    w = base + "e" if short(base) and r1 >= len(base) else base
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    for s, to, before in R.STEP_2:
        if w.endswith(s):
            base = w[:-len(s)]
            if len(base) >= r1 and (not before or base[-1:] in tuple(before)):
                w = base + to
            break
    for s, to, reg in R.STEP_3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if reg == 2 else r1):
                w = w[:-len(s)] + to
            break
    for s, before in R.STEP_4:
        if w.endswith(s):
            base = w[:-len(s)]
            if len(base) >= r2 and (not before or base[-1:] in tuple(before)):
                w = base
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def test_stems_by_hand(spark):
    frame = spark.createDataFrame([(w,) for w in STEMS], "term string")
    assert {r.term: r.stem for r in stem_table(frame).collect()} == STEMS


def test_stems_equal_the_plain_version(spark):
    words = set(R.SPECIAL) | set(R.KEPT_AFTER_PLURAL)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect():
        words |= set(re.findall("[a-z0-9]+", r.text.lower()))
    words |= {a + s for a in ("act", "nation", "vis", "y", "hop", "general", "sky") for s, *_ in R.STEP_2 + R.STEP_4 + R.STEP_3}
    got = stem_table(spark.createDataFrame([(w,) for w in words], "term string")).collect()
    assert len(got) == len(words)
    bad = [(r.term, r.stem, plain_stem(r.term)) for r in got if r.stem != plain_stem(r.term)]
    assert not bad, bad[:5]


def keys(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "Fractures of the wrist"), (2, "wrist fracture, burned hand"), (3, "burns"), (4, ""), (5, None), (6, "hand hand HAND")]
    return spark.createDataFrame(rows, "encounter_id long, t string")


def test_stemmed_search(texts):
    find = lambda p, n=None: keys(po.stemmed_keys(texts, "encounter_id", "t", p, n))
    assert find(["fracture"]) == find(["Fracturing"]) == [1, 2] and find(["burn"]) == [2, 3]
    assert find(["burn"], ["fractured"]) == [3] and find(None, ["burning"]) == [1, 4, 6] and find([]) == []


def test_a_failed_batch_of_postings_does_not_count(spark, texts, tmp_path, monkeypatch):
    p = po.Postings(spark, str(tmp_path), buckets=4)
    p.add(texts.where("encounter_id = 4"), "t")  # no terms at all
    with monkeypatch.context() as m:
        m.setattr(po.sk, "append", lambda df, path: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            p.add(texts, "t")
    p.add(texts, "t")
    p.add(spark.createDataFrame([(6, "a wrist")], "encounter_id long, t string"), "t")
    got = p.document_frequency()
    assert {r.term: r.doc_freq for r in got.where("term in ('wrist', 'hand', 'burns')").collect()} == {"wrist": 3, "hand": 1, "burns": 1}
    assert {r.encounter_id: r.r for r in p.rank(["hand", "wrist"]).collect()} == {1: 1, 2: 2, 6: 1}
    assert "Aggregate [term" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Aggregate [") == 2
    rows = p._read("postings", p.posting)
    again = spark.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)
    again.write.mode("append").partitionBy("bucket").parquet(str(tmp_path / "postings"))  # all of them twice
    assert {r.term: r.doc_freq for r in p.document_frequency().where("term = 'wrist'").collect()} == {"wrist": 3}


def test_terms_are_counted_in_their_row(spark, texts):
    rows = spark.createDataFrame([(7, " b a1 B, c b a1 "), (8, "x"), (9, "...")], "encounter_id long, t string").union(texts)
    got = po.term_counts(rows, "encounter_id", "t")
    want = {(r.encounter_id, w, n) for r in rows.collect()
            for w, n in Counter(re.findall("[a-z0-9]+", (r.t or "").lower())).items()}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stemmed_search_stems_no_text(texts):
    found = po.stemmed_keys(texts, "encounter_id", "t", ["burn"], ["fractured"])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # the steps of a stem


def test_postings_equal_a_scan(spark, texts, tmp_path):
    p = po.Postings(spark, str(tmp_path), buckets=4)
    p.add(texts.where("encounter_id < 3"), "t")
    p.add(texts, "t")
    p.add(texts, "t")  # nothing new
    assert p._read("indexed", p.entry).count() == 6
    for pos, neg in ((["wrist"], None), (["hand", "burns"], ["wrist"]), (["hand"], []), ([], ["wrist"]), (["none"], None), ([], [])):
        want = se.keyword_match(texts.fillna(""), "t", pos, neg).select("encounter_id")
        assert keys(p.keys(pos, neg)) == keys(want), (pos, neg)
    assert {r.encounter_id: r.r for r in p.rank(["hand", "wrist"]).collect()} == {1: 1, 2: 2, 6: 3}
    # a text that changes counts in its last writing only
    p.add(spark.createDataFrame([(6, "foot"), (7, "wrist")], "encounter_id long, t string"), "t")
    assert keys(p.keys(["hand"])) == [2] and keys(p.keys(["foot"])) == [6] and keys(p.keys(["wrist"])) == [1, 2, 7]
    assert {r.term: r.doc_freq for r in p.document_frequency().collect()}["wrist"] == 3
    # a batch that failed before its texts were entered is added again: its rows count once
    q = po.Postings(spark, str(tmp_path / "again"), buckets=4)
    q.add(texts, "t")
    rows = q._read("postings", q.posting)
    sk_rows = [tuple(r) for r in rows.collect()]
    spark.createDataFrame(sk_rows, rows.schema).write.mode("append").partitionBy("bucket").parquet(str(tmp_path / "again" / "postings"))
    assert {r.encounter_id: r.r for r in q.rank(["hand"]).collect()} == {2: 1, 6: 3}


def test_postings_plan_reads_no_text(spark, texts, tmp_path):
    p = po.Postings(spark, str(tmp_path))
    p.add(texts, "t")
    plan = p.keys(["hand"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "LogicalRDD" not in plan and not re.search(r"\bt#", plan)
