"""The pipeline's stages against brute force, on rows with planted cases."""

import base64
import random
import string

import corpus_pipeline as P
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    real = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(80).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    r = random.Random(2)
    docs = list(real)
    docs += [(1000 + i, t[1].swapcase() if t[1].isascii() else t[1], *t[2:]) for i, t in enumerate(real[:10])]  # equal but for case
    for i, t in enumerate(real[10:20]):  # near copies
        w = t[1].split(" ")
        w[r.randrange(len(w))] = "changedword"
        docs.append((1100 + i, " ".join(w), *t[2:]))
    docs += [(1200 + i, real[30 + i][1] + " " + items[i][1], *real[30 + i][2:]) for i in range(3)]  # leaks
    docs += [(1300, None, "en", "s", 0), (1301, "", "en", "s", 0), (1302, "12 34 !!", None, "s", 8)]
    frame = spark.createDataFrame(docs, COLUMNS)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def after(name, df):
        path = f"{tmp_path}/{name}"
        dict(P.STAGES)[name](spark, df, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        rows = sorted(tuple(x) for x in out.collect())
        if name != "sentencepiece":
            assert out.columns == frame.columns
        return out, rows

    df, rows = after("language_id", frame)
    assert rows == sorted(d for d in docs if d[1] and any(c.isalpha() for c in d[1]))
    keep = {i for i, *_, kept, _ in brute.exact([d[:2] for d in rows]) if kept}
    want = [d for d in rows if d[0] in keep]
    df, rows = after("exact_dedup", df)
    assert rows == want
    want = [d for d, e in zip(rows, brute.jaccard([d[:2] for d in rows], 5, 80)) if e[2] == d[0]]
    df, rows = after("near_dedup", df)
    assert rows == want
    want = [d for d, e in zip(rows, brute.leaks([d[:2] for d in rows], items)) if not e[5]]
    df, rows = after("decontaminate", df)
    assert rows == want and len(rows) > 60
    df, ids = after("sentencepiece", df)
    assert sorted((x[0], x[4]) for x in ids) == [(d[0], brute.sha(d[1])) for d in rows] and all(x[5] for x in ids)


def test_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "sentencepiece"]


def test_language_stage_drops_noise(spark):
    r = random.Random(5)
    clean = [tuple(x) for x in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    noise = ["".join(r.choice(string.printable[:94]) for _ in range(800)) for _ in range(20)]
    noise += [base64.b64encode(r.randbytes(1200)).decode() for _ in range(20)]
    noise += ["x " + " ".join(str(r.randrange(10 ** 6)) for _ in range(100)) for _ in range(20)]
    docs = clean + [(10 ** 7 + i, t, None, "s", 0) for i, t in enumerate(noise)]
    out = [x["doc_id"] for x in P.language_id(spark, spark.createDataFrame(docs, COLUMNS).repartition(8, "doc_id"), "").collect()]
    assert sum(i >= 10 ** 7 for i in out) <= 3
    assert len(clean) - sum(i < 10 ** 7 for i in out) <= len(clean) // 200


def test_language_stage_without_labels(spark):
    docs = [(1, "some text", None, "s", 9), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "été", None, "s", 3)]
    assert {x["doc_id"] for x in P.language_id(spark, spark.createDataFrame(docs, COLUMNS), "").collect()} == {1, 4}
