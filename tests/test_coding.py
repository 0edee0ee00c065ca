"""Rule order of the diagnosis coding: every fixture text against its hand-worked codes."""

from pyspark.sql import functions as F

from caseflow.catalog.expected_codes import EXPECTED
from caseflow.functions import coding as cd


def test_body_part_and_nature_match_hand_worked_codes(spark):
    rows = [(k,) for k in EXPECTED] + [(None,)]
    df = spark.createDataFrame(rows, "diagnosis string").withColumn("_dx", F.lower("diagnosis"))
    df = df.withColumn("_bp", cd.body_part(F.col("_dx")))
    df = df.withColumn("_nb", cd.nature_and_body(F.col("_dx"), F.col("_bp")))
    got = {r["diagnosis"]: (r["_bp"], r["_nb"]["no"], r["_nb"]["bp"]) for r in df.collect()}
    for text, want in EXPECTED.items():
        assert got[text] == want, text
    assert got[None] == (None, None, None)


def test_precedence_edge_cases(spark):
    cases = {
        # "no" is a substring test: it hits "known" too, but rule 27 ("injury") fires first.
        "known allergy, no injury": (None, 27, None),
        # a lone "tic" of length three is a mental-health nature
        "tic": (None, 71, 900),
        # any foreign body qualifies for rule 37 once earlier rules fail
        "foreign body": (None, 37, None),
        # "injury"/"trauma" alone: body part only, nature from the first test (none here)
        "trauma to hip, infection": (510, None, 510),
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string").withColumn("_dx", F.lower("d"))
    df = df.withColumn("_bp", cd.body_part(F.col("_dx"))).withColumn(
        "_nb", cd.nature_and_body(F.col("_dx"), F.col("_bp")))
    got = {r["d"]: (r["_bp"], r["_nb"]["no"], r["_nb"]["bp"]) for r in df.collect()}
    assert got == cases


def test_disposition_code(spark):
    rows = [("LWBS", "", 10, 110, 1), ("Admit", "", 71, 900, 8), ("Admit", "", 12, 440, 7),
            ("Deceased", "", None, None, 9), ("Discharge", "see consult", None, None, 6),
            ("Discharge", "Consult", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "disp string, remark string, no1 int, bp1 int, want int")
    out = df.select(cd.disposition_code(F.coalesce("remark", F.lit("")), F.col("disp"), F.col("no1"),
                                        F.col("bp1")).alias("got"), "want").collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]
