"""Review of stored case versions: updates, and the tables they are read from."""

from __future__ import annotations

from caseflow.catalog import store
from caseflow.operators import versions as vs
from caseflow.session import prepare
from caseflow.sources import tables as tb

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_updates_meet_the_stored_table_once(spark):
    stored = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", None), (2, 1, "a", 5), (3, 4, "c", 1)],
                                   "encounter_id long, version int, x string, y int")
    upload = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "c", None), (4, "d", 1), (None, "e", 1)],
                                   "encounter_id long, x string, y int")
    got = vs.apply_updates(stored, upload, ["x", "y"])
    assert {tuple(r) for r in got.collect()} == {(1, "a", None, 3), (3, "c", None, 5), (4, "d", 1, 1), (None, "e", 1, 1)}
    assert plan(got).count("Join ") == 1


def test_latest_cases_derive_their_columns_after_the_choice(spark):
    got, want = tb.latest_cases(spark, SF), vs.latest_version(tb.stored_cases(spark, SF))
    assert sorted(got.columns) == sorted(want.columns)
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count()
    assert "place " in plan(got).split("Aggregate")[0] and "place " not in "".join(plan(got).split("Aggregate")[1:])


def test_merged_partitions_are_bounded(spark):
    assert prepare(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_versions_of_a_visit_are_written_together(spark, monkeypatch):
    from caseflow.sources import sinks as sk
    written, append = [], sk.append
    monkeypatch.setattr(sk, "append", lambda df, path: (written.append(plan(df)), append(df, path)))
    store.review_round_trip(spark, SF)
    assert "RebalancePartitions [l_orderkey" in written[0] and len(written) == 2
