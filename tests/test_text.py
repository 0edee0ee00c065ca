from pyspark.sql import functions as F

from caseflow.functions import text as tx
from caseflow.operators import deid as dd
from caseflow.operators import sections as sc


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_expand_terms_edges(spark):
    assert _one(spark, tx.expand_terms, "pt c/o # of l wrist") == "patient complaining of fracture of left wrist"
    # matching is case-sensitive: "L" is not a dictionary term
    assert _one(spark, tx.expand_terms, "L wrist") == "L wrist"
    # an apostrophe is a word edge, so "I'm" expands its "m" (kept as specified)
    assert _one(spark, tx.expand_terms, "I'm ok") == "I'meters ok"
    # "$" in an expansion is literal
    assert _one(spark, tx.expand_terms, "swallowed a loonie") == "swallowed a $1 coin"
    # terms glued to letters or digits are left alone
    assert _one(spark, tx.expand_terms, "ptx abx2") == "ptx abx2"
    assert _one(spark, tx.expand_terms, "###") == "fracturefracturefracture"


def test_collapse_ws(spark):
    assert _one(spark, tx.collapse_ws, "  a \n\t b  c ") == "a b c"


def test_section_filter(spark):
    text = ("pre text Chief Complaint: fell PMH: asthma Assessment and Plan cast DIAGNOSES wrist fracture "
            "Social History: lives at home")
    df = spark.createDataFrame([(1, text), (2, "no headers at all"), (3, "PMH: only removed")],
                               "id long, text string")
    out = {r["id"]: r["text"] for r in sc.filter_sections(df, "text").collect()}
    assert out[1] == "fell cast pre text wrist fracture"
    assert out[2] == "no headers at all"
    assert out[3] == ""


def test_longest_header_wins(spark):
    df = spark.createDataFrame([(1, "x PAST MEDICAL HISTORY y HPI z")], "id long, text string")
    out = sc.filter_sections(df, "text").first()["text"]
    assert out == "z x"


def test_deidentify_tolerance(spark):
    notes = spark.createDataFrame([(1, "Seen with Al and Jonathn, al said dob: 01/02/2003 mrn 12345")],
                                  "encounter_id long, note_text string")
    names = spark.createDataFrame([(1, "Al, Jonathan")], "encounter_id long, subject_name string")
    out = dd.deidentify(notes, names).first()["note_text"]
    # "al" (2 letters) must match exactly; "jonathn" is within 2 edits of "jonathan"
    assert out == "seen with pt and pt, pt saidpt [redacted]"


def test_deidentify_names_next_to_other_characters(spark):
    notes = spark.createDataFrame([(1, "seen with Lee, lee\nand LEE. lee ok. smith's smith (Smit) lees O'Neil-Smith fleece"),
                                   (2, "Lee is no name here"), (3, None), (4, "")],
                                  "encounter_id long, note_text string")
    names = spark.createDataFrame([(1, "Lee, Smith"), (1, "Lee, Smith"), (4, "Lee")],
                                  "encounter_id long, subject_name string")
    out = {r["encounter_id"]: r["note_text"] for r in dd.deidentify(notes, names).collect()}
    assert out == {1: "seen with pt, pt\nand pt. pt ok. pt's pt (pt) lees o'neil-smith fleece",
                   2: "lee is no name here", 3: None, 4: ""}


def test_word_windows(spark):
    words = " ".join(str(i) for i in range(1030))
    df = spark.createDataFrame([(1, words)], "encounter_id long, note_text string")
    rows = sorted(dd.word_windows(df).collect(), key=lambda r: r["window_no"])
    # 1030 words, max 512 → 3 windows of ceil(1030/3) = 344 words (last shorter)
    assert [len(r["window_text"].split(" ")) for r in rows] == [344, 344, 342]


def test_keyword_search_without_terms_is_empty(spark):
    from caseflow.operators import search as se
    df = spark.createDataFrame([(1, "fell on ice")], "encounter_id long, summary_text string")
    assert se.keyword_keys(df, "summary_text", [], []).count() == 0
    assert se.keyword_keys(df, "summary_text", ["the"], None).count() == 0


def test_section_filter_in_any_case(spark):
    text = "Past medical history: asthma Chief complaint: fell assessment AND plan cast"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert sc.filter_sections(df, "text").first()["text"] == text
    assert sc.filter_sections(df, "text", ignore_case=True).first()["text"] == "fell cast"


def test_merge_note_ids_distinct_lines_and_missing_ids(spark):
    from caseflow.plans.notes import merge_note_ids
    cols = ["encounter_id", "note_type", "author_type", "author_service", "line", "note_text"]
    line = lambda e, n, t: (e, "ED Provider Notes", "MD", "Emergency", n, t)
    rows = [(10, *line(1, 1, "a")), (10, *line(1, 1, "a")), (10, *line(1, 2, "a")), (10, *line(1, 3, "b")),
            (None, *line(2, 1, "x")), (None, *line(2, 1, "x")), (None, *line(2, 2, "y")), (None, *line(3, 1, "x"))]
    want = {(1, "a a b"), (2, "x"), (2, "y"), (3, "x")}
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "note_id long, encounter_id long, note_type string, author_type string, "
                                   "author_service string, line int, note_text string")
        df = df.withColumn("note_id", df["note_id"].cast(kind))
        got = merge_note_ids(df).collect()
        assert len(got) == 4 and {(r["encounter_id"], r["note_text"]) for r in got} == want
        assert len({r["note_id"] for r in got}) == 4 and None not in {r["note_id"] for r in got}
        again = merge_note_ids(df.repartition(3)).collect()
        assert {r["note_id"] for r in again} == {r["note_id"] for r in got}  # so that a second batch appends nothing
    none = merge_note_ids(df.select(*cols)).collect()
    assert sorted((r["encounter_id"], r["note_text"]) for r in none) == [(1, "a"), (1, "b"), (2, "x"), (2, "y"), (3, "x")]


def test_expansion_equals_the_chain_on_random_texts(spark):
    """Random texts of terms, their parts and separators, against one replacement after another."""
    import random
    import re
    from caseflow.functions import text as tx
    from caseflow.rules.vocab import ABBREVIATIONS
    r = random.Random(3)
    words = [k for k, _ in ABBREVIATIONS] + ["the", "Fu", "w/", "é", "3", "x" * 40]
    seps = [" ", "", "/", "-", "'", "#", "@", "\n", ".", "  "]
    texts = ["".join(r.choice(words) + r.choice(seps) for _ in range(r.randrange(0, 14))) for _ in range(1500)] + ["", None]

    def chain(t, terms):
        for k, v in terms:
            t = re.sub(f"(?<![a-zA-Z0-9]){re.escape(k)}(?![a-zA-Z0-9])", lambda m: v, t)
        return t
    assert tx._one_pass_is_exact(ABBREVIATIONS)
    assert not tx._one_pass_is_exact([("a/b", "x y"), ("y", "z")]) and not tx._one_pass_is_exact([("a", "b"), ("b", "c")])
    listed = [("y", "z"), ("a/b", "x y")]  # exact, but not in one pass
    assert tx._run_lookup_is_exact(listed) and not tx._one_pass_is_exact(listed)
    texts += [" ".join(r.choice(["a/b", "y", "a", "b", "x", "a/b/y", "ya/b"]) for _ in range(6)) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for terms in (ABBREVIATIONS, listed):
        got = {row.i: row.x for row in frame.select("i", tx.expand_terms("t", terms).alias("x")).collect()}
        assert [got[i] for i in range(len(texts))] == [t if t is None else chain(t, terms) for t in texts]
