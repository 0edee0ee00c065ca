"""SimHash near duplicates against all pairs in plain code."""

import random

import numpy as np
import pytest
import xxhash

from caseflow.llm import simhash as S
from tests.llm.brute import SPACES, lower
from tests.llm.conftest import same, sentence


def plain_print(text):
    w = SPACES.findall(lower(text))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints, radius=4):
    """The lowest member of each member's component, over all pairs."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def plain(docs):
    prints = [plain_print(t) for _, t in docs]
    roots, low = reach(prints), {}
    for (i, _), r in zip(docs, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [(i, p - (1 << 64) if p >> 63 else p, low.get(r)) for (i, _), p, r in zip(docs, prints, roots)]


def family(seed, n, near=0.03):
    """Copies with a few changed words, so that fingerprints lie at all distances."""
    r = random.Random(seed)
    base = sentence(r, 150).split()
    return [(1000 * seed + i, " ".join("w%d" % r.randrange(99) if r.random() < near else w for w in base)) for i in range(n)]


@pytest.mark.parametrize("tiling", [{}, {"large": 8, "tile": 3}, {"blocks": 7, "large": 2, "tile": 5}, {"blocks": 6}])
def test_edge(spark, edge_docs, tiling):
    docs = edge_docs + family(2, 60) + family(3, 60, 0.01) + [(8, "")]
    frame = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in docs], "doc_id long, text string, fp int, n int, component string")
    same(S.near_groups(frame.repartition(4), **tiling), plain(docs))


def test_links_at_the_radius_only(spark):
    """Random fingerprints and neighbours at 3, 4 and 5 bits, in every choice of blocks."""
    r = random.Random(5)
    fps = []
    for _ in range(60):
        x = r.getrandbits(64)
        fps += [x] + [x ^ sum(1 << b for b in r.sample(range(64), d)) for d in (3, 4, 5)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    frame = spark.createDataFrame([(f, 1) for f in fps], "fp long, n long")
    from caseflow.llm.components import components
    want = reach([f % (1 << 64) for f in fps])
    for tiling in ({}, {"blocks": 6}, {"blocks": 8}, {"blocks": 5, "large": 1, "tile": 2}):
        got = {x.node: x.component for x in components(S.linked(frame, **tiling)).collect()}
        names = {}
        for f, w in zip(fps, want):
            names.setdefault(w, set()).add(got.get(f, f))
        assert all(len(n) == 1 for n in names.values()) and len(set.union(*names.values())) == len(names)


def test_every_pair_within_the_radius_shares_a_group():
    r = random.Random(6)
    for k in (5, 6, 7, 8):
        chosen = [m % (1 << 64) for m in S.masks(4, k)]
        for _ in range(300):
            diff = sum(1 << b for b in r.sample(range(64), 4))
            assert any(diff & m == 0 for m in chosen)
    assert [S.blocks_for(n, 4) for n in (1, 1 << 20, 1 << 25, 1 << 33, 1 << 45)] == [5, 5, 6, 7, 10]


def test_tile_pairs_too_far_apart_are_skipped():
    fp = np.array([(1 << k) - 1 for k in range(0, 64, 8)] * 4, np.uint64)
    a, b, compared = S.group_links(fp, 4, tile=4)
    assert compared == 8 and len(a) == 24 and (fp[a] == fp[b]).all()  # each tile holds one bit count


def test_empty(spark, empty_frame):
    assert S.near_groups(empty_frame).count() == 0


def test_registered_query(spark):
    out = S.op11_simhash(spark, "/root/testdata/sf0.001")
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same(out, [(i, "%016x" % (p % (1 << 64)), c) for i, p, c in plain(docs)])
