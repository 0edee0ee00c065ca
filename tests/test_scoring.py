from caseflow.operators.scoring import score_corpus


def test_score_corpus_separates_labelled_classes(spark):
    good = [(i, "clear useful sentence about the injury and the care given") for i in range(20)]
    bad = [(100 + i, "spam spam buy now cheap offer click") for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(100 + i, 0) for i in range(10)],
                                   "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in score_corpus(docs, labels, num_features=1 << 10).collect()}
    assert len(scores) == 40  # every document is scored, labelled or not
    assert min(scores[i] for i in range(20)) > 0.5 > max(scores[100 + i] for i in range(20))


WORDS = {10: "fell ladder", 11: "assault punched", 12: "overdose pills", 13: "cut knife self", 15: "crash vehicle", 16: "sad hopeless", 19: "unclear story"}


def _visits(spark, copies, start=0):
    rows = [(start + 100 * i + c, f"Patient {w}, seen by nurse {i % 5}.", c) for i in range(copies) for c, w in WORDS.items()]
    return spark.createDataFrame(rows, "encounter_id long, full_narrative string, intent int")


def _intents(df):
    return {r["encounter_id"]: r["intent"] for r in df.collect()}


def test_intent_held_out_saved_and_reloaded(spark, tmp_path):
    from caseflow.operators import scoring as so
    more = spark.createDataFrame([(5, "fell", 77), (6, "fell", None), (7, None, 11), (8, " -- ", 12)], "encounter_id long, full_narrative string, intent int")
    model = so.fit_classes(_visits(spark, 20).unionByName(more), "full_narrative", "intent", num_features=1 << 10)
    model.write().overwrite().save(str(tmp_path / "model"))
    held = _visits(spark, 6, 1_000_000)
    want = _intents(held)
    for m in (model, so.load_classes(str(tmp_path / "model"))):
        out = so.predict_classes(m, held, "encounter_id", "full_narrative").collect()
        assert {r["encounter_id"]: r["intent"] for r in out} == want
        assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and max(r["probabilities"]) == r["probability"] >= 0.8 for r in out)


def test_intent_defined_cases(spark):
    from caseflow.operators import scoring as so
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " .,; "), (4, "nurse"), (4, "nurse"), (5, "fell ladder " * 50_000)],
                                "encounter_id long, full_narrative string")
    model = so.fit_classes(_visits(spark, 20), "full_narrative", "intent", num_features=1 << 10)
    got = so.predict_classes(model, odd, "encounter_id", "full_narrative")
    rows = sorted((r["encounter_id"], r["intent"], r["probability"] is None) for r in got.collect())
    assert rows[:3] == [(1, None, True), (2, None, True), (3, None, True)]
    assert rows[3] == rows[4] == (4, None, False) and rows[5] == (5, 10, False)  # "nurse" tells nothing: below the cutoff
    assert so.predict_classes(model, odd.limit(0), "encounter_id", "full_narrative").count() == 0
    # nothing to learn from, and one class only
    none = so.fit_classes(_visits(spark, 1).limit(0), "full_narrative", "intent")
    assert none is None and set(_intents(so.predict_classes(none, odd, "encounter_id", "full_narrative")).values()) == {None}
    one = so.fit_classes(_visits(spark, 3).where("intent = 13"), "full_narrative", "intent", num_features=1 << 10)
    assert _intents(so.predict_classes(one, odd.where("encounter_id = 5"), "encounter_id", "full_narrative")) == {5: 13}
