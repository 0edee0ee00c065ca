"""Dedup operators against brute force."""

import os
import random

import numpy as np
import pytest

from caseflow.llm import partenum, radix_dedup, rlz_dedup, suffix_dedup
from caseflow.llm.blocks import Blocks
from caseflow.llm.components import components
from caseflow.session import shared_dir
from tests.llm import brute
from tests.llm.conftest import same

RLZ = ["doc_id", "n_words", "n_removed", "kept_sha256"]
BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_rlz_edge(edge_frame, edge_docs):
    same(rlz_dedup.parse(edge_frame).select(*RLZ), brute.rlz(edge_docs))


def test_rlz_factors_are_copies(spark):
    a, b = " ".join(map(str, range(60))), " ".join(map(str, range(30, 90)))
    docs = [(1, a), (2, b), (3, a + " " + b)]
    out = {r["doc_id"]: r["factors"] for r in rlz_dedup.parse(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1] == [] and [tuple(f) for f in out[2]] == [(0, 30, 1, 30)]
    words = {i: t.split() for i, t in docs}
    for f in out[3]:
        assert f.length >= 20
        assert words[3][f.start:f.start + f.length] == words[f.ref_doc][f.ref_start:f.ref_start + f.length]


def test_factorise_stops_where_the_source_does():
    pos, doc, ref = np.array([0, 1, 2, 5, 6]), np.array([1, 1, 2, 2, 2]), np.array([7, 8, 0, 3, 4])
    start, size, d, p = rlz_dedup.factorise(pos, doc, ref, 20)
    assert list(zip(start, size, d, p)) == [(0, 21, 1, 7), (2, 20, 2, 0), (5, 21, 2, 3)]


def test_radix_edge(edge_frame, edge_docs):
    same(radix_dedup.radix_groups(edge_frame, first_digit=2, widen=3).select(*radix_dedup.OUT), brute.exact(edge_docs))


def test_radix_keep_largest(edge_frame, edge_docs):
    out = radix_dedup.keep_largest(edge_frame)
    assert out.columns == edge_frame.columns
    kept = [(i, t) for (i, t), e in zip(edge_docs, brute.exact(edge_docs)) if e[3]]
    same(out.select("doc_id", "text"), kept)


def test_deep_shallow_sorts():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, depth, shallow = int(r.integers(1, 300)), int(r.integers(1, 40)), int(r.choice([8, 16, 24]))
        buf = r.integers(97, 97 + r.integers(1, 4), n).astype(np.uint8)
        at = r.permutation(max(0, n - depth + 1))
        order, cls = suffix_dedup.deep_shallow(suffix_dedup._padded(buf, depth + 60), at, depth, shallow)
        keys = [bytes(buf[a:a + depth]) for a in at]
        assert [keys[i] for i in order] == sorted(keys)
        rank = {k: i for i, k in enumerate(sorted(set(keys)))}
        assert [rank[k] for k in keys] == list(cls)


def test_suffix_edge(edge_frame, edge_docs):
    same(suffix_dedup.duplicate_bytes(edge_frame).select(*BYTES), brute.suffix(edge_docs))


def test_suffix_frequent_seeds_are_dealt_singly(edge_frame, edge_docs):
    same(suffix_dedup.duplicate_bytes(edge_frame, frequent=2).select(*BYTES), brute.suffix(edge_docs))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_partenum_edge(edge_frame, edge_docs, k, num):
    same(partenum.link(edge_frame, k, num), brute.jaccard(edge_docs, k, num))


def test_partenum_chain_through_a_hub(spark):
    # every copy links with the original only; the copies among themselves are too far apart
    base = [f"w{i}" for i in range(102)]
    docs = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        w[2 * i + 3] = w[(2 * i + 50) % 100] = f"c{i}"
        docs.append((i, " ".join(w)))
    same(partenum.link(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90), brute.jaccard(docs))


def test_partenum_rounds_and_pieces(edge_frame, edge_docs, monkeypatch):
    monkeypatch.setattr(partenum, "PIECE", 2)
    monkeypatch.setattr(partenum, "ROUND", 0.5)
    same(partenum.link(edge_frame, 3, 80), brute.jaccard(edge_docs, 3, 80))


def test_texts_under_one_key_lie_in_many_blocks(spark):
    store = Blocks(spark.createDataFrame([(None, f"text {i}") for i in range(64)] + [(5, f"text {i}") for i in range(64)],
                                         "doc_id long, text string"), block_bytes=64)
    assert store.n_blocks > 8 and store.df.select("block").distinct().count() > 8
    path = store._scratch[0]
    assert path.startswith(shared_dir(spark))
    store.drop()
    assert not os.path.exists(path)


def test_keep_one(edge_frame, edge_docs):
    out = partenum.keep_one(edge_frame, 5, 80)
    assert out.columns == edge_frame.columns
    same(out.select("doc_id", "text"), [d for d, e in zip(edge_docs, brute.jaccard(edge_docs, 5, 80)) if e[2] == d[0]])


def test_repeated_ids_with_different_texts(spark):
    r = random.Random(3)
    text = lambda: [f"w{r.randrange(10 ** 6)}" for _ in range(100)]
    near = lambda w: " ".join([*w[:99], "end"])
    a, c, e, f, g = (text() for _ in range(5))
    docs = [(3, near(a)), (7, " ".join(a)), (7, " ".join(c)), (9, near(c)), (None, " ".join(e)), (None, near(e)), (None, " ".join(f)),
            (12, near(f)), (15, " ".join(g)), (15, near(g)), (20, " ".join(text())), (20, " ".join(text())), (None, None), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same(partenum.link(df, 5, 80), brute.jaccard(docs, 5, 80))
    kept = [tuple(x) for x in partenum.keep_one(df, 5, 80).collect()]
    whole = [docs[i] for i in (0, 2, 6, 10, 11, 12, 13)]
    assert all(kept.count(d) == 1 for d in whole) and len(kept) == len(whole) + 2
    assert sum(d in kept for d in docs[4:6]) == 1 and sum(d in kept for d in docs[8:10]) == 1


def test_components(spark):
    r = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(5, 5)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = {x for a, b in links if a != b for x in (a, b)}
    same(components(spark.createDataFrame(links, "a long, b long")), [(x, find(x)) for x in nodes])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(empty_frame):
    assert rlz_dedup.parse(empty_frame).count() == 0
    assert radix_dedup.keep_largest(empty_frame).count() == 0
    assert suffix_dedup.duplicate_bytes(empty_frame).count() == 0
    assert partenum.keep_one(empty_frame).count() == 0


def test_partenum_family_of_uneven_copies(spark):
    # copies with 1 to 4 edits of one text, and of a second text some edits away from the first
    import random
    r = random.Random(9)
    first = [f"w{i}" for i in range(110)]
    second = [f"v{w}" if i % 23 == 0 else w for i, w in enumerate(first)]
    docs = []
    for i in range(160):
        w = list(first if i % 3 else second)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(110)] = f"x{r.randrange(400)}"
        docs.append((i, " ".join(w[:r.randint(104, 110)])))
    for k, num in ((3, 90), (5, 80)):
        want = brute.jaccard(docs, k, num)
        assert 50 < len({c for *_, c in want}) < 150
        same(partenum.link(spark.createDataFrame(docs, "doc_id long, text string"), k, num), want)


@pytest.mark.parametrize("passes", [1, 3])
def test_partenum_passes(edge_frame, edge_docs, monkeypatch, passes):
    monkeypatch.setattr(partenum, "PASSES", passes)
    same(partenum.link(edge_frame, 5, 80), brute.jaccard(edge_docs, 5, 80))


def test_partenum_common_passage_makes_no_pairs(spark, monkeypatch):
    # documents that share a passage and nothing else, and so signatures; a few are near copies besides
    r = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join(passage + [f"w{r.randrange(10 ** 7)}" for _ in range(r.randint(70, 90))])) for i in range(200)]
    docs += [(500 + i, docs[i][1] + f" end{i}") for i in range(5)]
    counts, compared = [], partenum.compared

    def counted(pairs, *rest, **more):
        counts.append(pairs.count())
        return compared(pairs, *rest, **more)
    monkeypatch.setattr(partenum, "compared", counted)
    same(partenum.link(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80), brute.jaccard(docs, 5, 80))
    assert sum(counts) <= 15 * len(docs)
