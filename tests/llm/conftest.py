import random

import pytest

PROSE = ("the quick brown fox jumps over a lazy dog while seven wise owls watch from old oak trees near quiet river "
         "banks and count every star that falls into deep blue water before dawn breaks again").split()


def sentence(r, n):
    return " ".join(r.choice(PROSE) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs():
    """(doc_id, text): nulls, empties, one word, copies that differ in case, near copies, shared
    passages, repeats in one document, a repeated row, a long text, long words, odd characters."""
    r = random.Random(4)
    passage, base = sentence(r, 60), sentence(r, 120)
    docs = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "Word"), (6, "two words"), (7, None), (8, "word")]
    docs += [(20 + i, base if i % 2 else base.upper().lower()) for i in range(12)]
    for i in range(12):
        w = base.split()
        w[7 * i % 120] = "changed%d" % i
        docs.append((40 + i, " ".join(w)))
    docs += [(60 + i, sentence(r, 15) + " " + passage + "\n" + sentence(r, 9)) for i in range(8)]
    docs += [(80, " ".join(["again and again"] * 40)), (81, "a" * 300), (82, "x " * 70), (83, "é" * 90 + " ▁▁ 𝄞\x00￾ end")]
    docs += [(90, sentence(r, 5000)), (91, "ab" * 4000 + " tail"), (92, "   lead  and\ttrail\r\n")]
    docs += [(100 + i, sentence(r, 40)) for i in range(20)]
    docs += [(100, docs[-20][1]), (100, docs[-20][1]), (-5, passage), (None, passage + " more of it"), (None, "")]
    r.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def edge_frame(spark, edge_docs):
    """The same rows with extra columns whose names the operators use inside."""
    rows = [(i, t, "x", 1, "y", 2.0, i, "z") for i, t in edge_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, part int, key string, score double, "
                                 "component_id long, _gone string").repartition(5)


@pytest.fixture(scope="session")
def empty_frame(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def same(df, expected, digits=6):
    norm = lambda rows: sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    got = norm(tuple(r) for r in df.collect())
    want = norm(expected)
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b) if len(got) == len(want) else (len(got), len(want))
