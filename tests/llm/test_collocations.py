"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from caseflow.llm import collocations as C
from tests.llm.brute import lower
from tests.llm.conftest import same


def plain(docs, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    out = []
    for (lang, w), a in cand.items():
        if any(x == lang and len(v) > len(w) and 100 * c >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v)))
               for (x, v), c in cand.items()):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    rows = []
    for lang in n:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        rows += [(r[0], i, *r[1:]) for i, r in enumerate(best, 1)]
    return rows


def corpus(seed, n=300):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(40)] + ["É", "Ab", "aB", "x\x00", " "]
    fixed = ["New York City hall", "à la carte", "one\ttwo  three", "red. green; blue"]
    docs = []
    for i in range(n):
        w = [r.choice(fixed) if r.random() < 0.2 else words[int(len(words) * r.random() ** 3)] for _ in range(r.randrange(0, 60))]
        docs.append((r.choice(["en", "fr", None, "und", "x'"]), r.choice([" ", "  ", "\t"]).join(w) + r.choice(["", ".", "\n", "!?"])))
    return docs + [("en", None), ("en", ""), (None, " \t "), ("fr", ".,;"), ("de", "one word")] + docs[:20]


@pytest.mark.parametrize("least,sizes", [(30, {}), (8, {"block_bytes": 500, "part_bytes": 200}), (3, {"block_bytes": 3000, "room": 1})])
def test_edge(spark, least, sizes):
    docs = corpus(least)
    frame = spark.createDataFrame([(i, x, t, 1, "p") for i, (x, t) in enumerate(docs)], "doc_id long, lang string, text string, n int, phrase string")
    want = plain(docs, least)
    assert want
    same(C.collocations(frame.repartition(3), least=least, **sizes), want)


def test_top(spark):
    docs = corpus(1)
    frame = spark.createDataFrame([(x, t) for x, t in docs], "lang string, text string")
    same(C.collocations(frame, least=5, top=3), plain(docs, 5, 3))


def test_summary_keeps_every_frequent_key():
    """Whatever the order of merging, and with summaries of summaries."""
    for seed in range(40):
        r = np.random.default_rng(seed)
        least = int(r.integers(2, 12))
        stream = (r.random(3000) ** int(r.integers(1, 6)) * 2000).astype(np.uint32)
        capacity = len(stream) // least + 1
        whole, inner, true = C.Summary(capacity), [], Counter(stream.tolist())
        for chunk in np.array_split(stream, int(r.integers(1, 20))):
            s = C.Summary(capacity)
            for piece in np.array_split(chunk, 7):
                s.merge(*np.unique(piece, return_counts=True))
            s.settle()
            assert len(s.keys) <= capacity
            inner.append(s)
        for s in inner:
            whole.merge(s.keys, s.counts, s.lost)
        found = set(whole.reaching(least).tolist())
        assert whole.lost < least and len(whole.keys) <= capacity
        assert {k for k, n in true.items() if n >= least} <= found
        assert all(true[k] >= n for k, n in zip(whole.keys.tolist(), whole.counts.tolist()))


def test_press_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        v = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert (C.unpress(C.press(v), n) == v).all()


def test_scores_pass_64_bits(spark):
    big = 7_000_000_000_000
    rows = [("en", 0, "", 10 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 2), ("en", 2, "a b", big)]
    out = C.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).collect()
    assert [tuple(r) for r in out] == [("en", "a b", big, big + 1, big + 2, 10 * big, 2000000 * big // (2 * big + 3))]


def test_empty(spark, empty_frame):
    assert C.collocations(empty_frame).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "too few words"), (None, None)], "lang string, text string")).count() == 0
