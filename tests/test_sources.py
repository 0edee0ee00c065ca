import os
import tempfile

import pytest

from caseflow.sources import note_dump as nd


def _write(lines):
    d = tempfile.mkdtemp(prefix="caseflow-dump-")
    with open(os.path.join(d, "day1.txt"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_dump_surplus_short_and_non_ascii(spark):
    d = _write(["CSN|MRN|Note Text", "1|10|fell | hit head", "2|20|café visit  ", "3|30"])
    rows, rejects = nd.read_note_dump(spark, d, "CSN")
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [("1", "10", "fell   hit head"), ("2", "20", "caf visit")]
    assert [r["line"] for r in rejects.collect()] == ["3|30"]
    with pytest.raises(ValueError):
        nd.read_note_dump(spark, d, "CSN", mode="strict")


def test_dump_without_header_is_an_error(spark):
    d = _write(["1|10|text"])
    with pytest.raises(ValueError):
        nd.read_note_dump(spark, d, "CSN")


def test_headered_export_title_line(spark):
    d = _write(["Weekly export", "MRN,CSN", "10,1", "20,2"])
    rows, rejects = nd.read_headered_export(spark, d, "MRN")
    assert sorted(tuple(r) for r in rows.collect()) == [("10", "1"), ("20", "2")] and rejects.count() == 0
    with pytest.raises(ValueError):
        nd.read_headered_export(spark, d, "NOPE")


def test_headered_export_keeps_every_line(spark):
    d = _write(["id,text", '1,plain', '2,"a, b"', "3,x,y", "4", '5,"say ""hi"""', "6,"])
    rows, rejects = nd.read_headered_export(spark, d, "id")
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "plain"), ("2", "a, b"), ("5", 'say "hi"'), ("6", None)]
    assert sorted(r["line"] for r in rejects.collect()) == ["3,x,y", "4"]


def test_typed_lines_never_fail(spark):
    cols = ["encounter_id", "subject_id", "arrival_datetime", "departure_datetime", "ctas"]
    rows = [("1", "2.0", "2024-03-05 10:00:00", "2024-03-05 12:30:00", "3"),
            ("x", "99999999999999999999", "3/5/2024 9:15", "5-Mar-2024 10:15", "three"), ("3", "", "soon", None, " ")]
    out = nd.type_note_lines(spark.createDataFrame(rows, cols)).collect()
    assert [(r["encounter_id"], r["subject_id"], r["los"], r["arrival_time"], r["ctas"]) for r in out] == [
        (1, 2, 2.5, "10:00:00", 3), (None, None, 1.0, "09:15:00", None), (3, None, None, None, 0)]


def test_coded_fields_never_fail(spark):
    from pyspark.sql import functions as F
    from caseflow.functions import fields as ff
    vals = ["12", "12.0", "-3.", "twelve", "12.5", "12345678901", "", None, " 7 "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(ff.int_or_null("v")).collect()] == [12, 12, -3, None, None, None, None, None, 7]
    hours = spark.createDataFrame([(v,) for v in ["ten", "0", "15.0", "99", None]], "v string")
    assert [r[0] for r in hours.select(ff.ampm_from_hour(F.col("v"))).collect()] == [None, 1, 2, 99, None]


def test_declared_read(spark, tmp_path):
    from caseflow.sources.tables import read_stored
    with pytest.raises(ValueError, match="nothing is stored"):
        read_stored(spark, str(tmp_path / "none"))
    root = str(tmp_path / "store")
    read = lambda n, **o: read_stored(spark, root, [n], **o)[n]
    # an added column is null, an undeclared one is not read, a narrower number is taken
    spark.createDataFrame([(1, "a summary", 1, True)], "encounter_id int, summary_text string, version int, extra boolean").write.parquet(f"{root}/summaries")
    assert [tuple(r) for r in read("summaries").collect()] == [(1, "a summary", 1, None)]
    assert read("summaries").schema["encounter_id"].dataType.simpleString() == "bigint"
    assert [tuple(r) for r in spark.sql("SELECT encounter_id, vec FROM summaries").collect()] == [(1, None)]
    # nothing written yet
    assert read("problems").count() == 0 and read("problems").columns == ["encounter_id", "problem", "id", "arrival_part"]
    # a changed type is refused by name, in one file of several too
    spark.createDataFrame([("7", 3)], "subject_id string, dob int").write.parquet(f"{root}/subjects")
    with pytest.raises(ValueError, match="subject_id is stored as string, declared as bigint; dob is stored as int, declared as date"):
        read("subjects")
    spark.createDataFrame([(2, 5, 1)], "encounter_id long, summary_text int, version int").write.mode("append").parquet(f"{root}/summaries")
    with pytest.raises(Exception, match="(?i)merge|declared as"):
        read("summaries", every_file=True)
    # partitions by day stay strings
    spark.createDataFrame([(1, "p", "1|p", "1998-06-01")], "encounter_id long, problem string, id string, arrival_part string") \
        .write.partitionBy("arrival_part").parquet(f"{root}/problems")
    assert [tuple(r) for r in read("problems").collect()] == [(1, "p", "1|p", "1998-06-01")]
    with pytest.raises(ValueError, match="unknown table"):
        read("nothing")


def test_reader_by_extension(spark, tmp_path):
    (tmp_path / "day.txt").write_text("CSN|MRN\n1|10\n2\n")
    (tmp_path / "day.CSV").write_text("MRN,CSN\n10,1\n")
    spark.createDataFrame([(1, None, 2.5)], "CSN long, `a.b` string, los double").write.parquet(str(tmp_path / "day.parquet"))
    get = lambda name, **o: [sorted(tuple(r) for r in p.collect()) for p in nd.read_notes(spark, str(tmp_path / name), "CSN", **o)]
    assert get("day.txt") == [[("1", "10")], [("2",)]]
    assert get("day.CSV") == [[("10", "1")], []]
    assert get("day.parquet") == [[("1", None, "2.5")], []]
    (tmp_path / "notes").write_text("CSN;MRN\n3;30\n")
    assert get("notes", format="dump", delim=";") == [[("3", "30")], []]
    with pytest.raises(ValueError, match="no reader"):
        get("day.xlsx")
    with pytest.raises(ValueError, match="not found"):
        nd.read_notes(spark, str(tmp_path / "day.parquet"), "MRN")
