import tempfile

from pyspark.sql import functions as F

from caseflow.streaming import drops as st
from tests.conftest import SF_SMALL


def test_new_keys_replay_appends_nothing(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        F.col("o_orderkey").alias("encounter_id"), F.year("o_orderdate").alias("y"))
    base = tempfile.mkdtemp(prefix="caseflow-drops-")
    # two drops that overlap in half of their keys
    o.where(F.col("encounter_id") % 2 == 0).write.parquet(f"{base}/drops/a")
    o.write.parquet(f"{base}/drops/b")
    schema = o.schema
    table = f"{base}/table"
    st.run_new_keys(spark, f"{base}/drops/a", schema, "encounter_id", table, checkpoint=f"{base}/ck/a")
    st.run_new_keys(spark, f"{base}/drops/b", schema, "encounter_id", table, checkpoint=f"{base}/ck/b")
    first = spark.read.parquet(table)
    assert first.count() == o.count() == first.select("encounter_id").distinct().count()
    # a lost checkpoint (re-run from scratch) must not duplicate anything
    st.run_new_keys(spark, f"{base}/drops/b", schema, "encounter_id", table, checkpoint=f"{base}/ck/b-again")
    assert spark.read.parquet(table).count() == o.count()


HEAD = ["CSN", "MRN", "Note Text"]


def _drop(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_file_drop_rows_and_rejects_in_one_pass(spark, tmp_path):
    drops, table = tmp_path / "drops", str(tmp_path / "table")
    both = lambda: [sorted(tuple(r) for r in part.collect()) for part in st.read_file_drop(spark, table, HEAD)]
    assert both() == [[], []]  # nothing came yet
    _drop(drops, "a.txt", ["CSN|MRN|Note Text", "1|10|fell | hit head", "", "2|20", "3||", "3||"])
    st.run_file_drop(spark, str(drops), HEAD, "CSN", table)
    first = both()
    assert first == [[("1", "10", "fell   hit head"), ("3", "", ""), ("3", "", "")], [("2|20",)]]
    st.run_file_drop(spark, str(drops), HEAD, "CSN", table)
    assert both() == first  # no new file
    _drop(drops, "b.txt", ["4|40|burn", "x"])
    st.run_file_drop(spark, str(drops), HEAD, "CSN", table)
    second = both()
    assert second == [sorted(first[0] + [("4", "40", "burn")]), [("2|20",), ("x",)]]


def test_file_drop_replayed_batch_adds_nothing(spark, tmp_path):
    drops, table = tmp_path / "drops", str(tmp_path / "table")
    _drop(drops, "a.txt", ["1|10|fell", "2|20"])
    st.run_file_drop(spark, str(drops), HEAD, "CSN", table)
    _drop(drops, "b.txt", ["3|30|burn", "4"])
    st.run_file_drop(spark, str(drops), HEAD, "CSN", table)
    both = lambda: [sorted(tuple(r) for r in part.collect()) for part in st.read_file_drop(spark, table, HEAD)]
    before = both()
    # the job ended after it wrote batch 1 and before it was committed
    commits = sorted((tmp_path / "table_checkpoint" / "commits").glob("[0-9]*"))
    assert [c.name for c in commits] == ["0", "1"]
    commits[-1].unlink()
    (commits[-1].parent / ".1.crc").unlink(missing_ok=True)
    st.run_file_drop(spark, str(drops), HEAD, "CSN", table)
    assert both() == before == [[("1", "10", "fell"), ("3", "30", "burn")], [("2|20",), ("4",)]]
