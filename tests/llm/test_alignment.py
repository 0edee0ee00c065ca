"""Cross-tokenizer alignment against plain code."""

from collections import Counter

import numpy as np
import pytest

from caseflow.llm import token_align as T
from tests.llm.brute import sha
from tests.llm.conftest import same

COLS = T.OUT
ODD = [(200, "<|endoftext|> and <s> </s> <0x41>"), (201, "中文字符没有空格 𝄞 é"), (202, "   "), (203, "\n\n\ttabs\r\n"),
       (204, "x" * 30_000), (205, " " * 5_000 + "end"), (206, "don't we'll I'VE 12345"), (207, "▁ already ▁▁")]


def plain(docs):
    """The contract, read literally: the slow encoder, sets of ends, one link at a time."""
    enc_a, (_, names_a), (enc_b, names_b) = T._tokenizers(T.A_FILE), T.tokenizer_a(T.A_FILE), T.tokenizer_b(T.B_FILE)
    done, count = [], Counter()
    for i, text in docs:
        a = b = ()
        if text:
            a, b = enc_a(" " + text), enc_b(text)
            want = (" " + text).encode()
            if b"".join(names_a[x] for x in a) != want or b"".join(names_b[x] for x in b) != want:
                a = b = ()
        ends = [{int(e): k for k, e in enumerate(np.cumsum([len(n[x]) for x in ids]))} for ids, n in ((a, names_a), (b, names_b))]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, at_a, at_b = [], [], 0, 0
        for e in common:
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[at_a:p])) + "|" + ",".join(map(str, b[at_b:q])))
            links.append((a[p - 1], b[q - 1]))
            at_a, at_b = p, q
        count.update(links)
        done.append((i, len(a), len(b), groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(i, n_a, n_b, len(g), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             sha(";".join(g)) if g else "") for i, n_a, n_b, g, links in done]


def test_edge(spark, edge_docs):
    docs = edge_docs + ODD
    frame = spark.createDataFrame([(i, t, "x", 3, 4) for i, t in docs], "doc_id long, text string, slice string, place int, pair int")
    same(T.link_counts(frame.repartition(3)).select(*COLS), plain(docs))


def test_groups_rebuild_the_text(spark, edge_docs):
    (_, names_a), (_, names_b) = T.tokenizer_a(T.A_FILE), T.tokenizer_b(T.B_FILE)
    docs = [(i, t) for i, t in edge_docs + ODD if t and i is not None and i != 100]
    text = dict(docs)
    for r in T.alignments(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        a = b = 0
        got = b""
        for p, q in zip(r.a_cuts, r.b_cuts):
            left = b"".join(names_a[x] for x in r.a_ids[a:p])
            assert left == b"".join(names_b[x] for x in r.b_ids[b:q])
            got, a, b = got + left, p, q
        assert (a, b) == (len(r.a_ids), len(r.b_ids)) and got in ((" " + text[r.doc_id]).encode(), b"")


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50, 10_000])
def test_pieces_give_the_same_merge(piece):
    r = np.random.default_rng(piece)
    for _ in range(60):
        end = int(r.integers(1, 80))
        a, b = (np.unique(np.append(r.integers(1, end + 1, int(r.integers(0, 40))), end)) for _ in range(2))
        i, j, e, meet = T.overlaps(a, b, piece)
        want = sorted(set(a) | set(b))
        assert e.tolist() == want and meet.tolist() == [x in set(a) & set(b) for x in want]
        assert i.tolist() == [int(np.searchsorted(a, x)) for x in want] and j.tolist() == [int(np.searchsorted(b, x)) for x in want]
        ia, jb = T.diagonals(a, b, piece)
        assert np.diff(ia + jb).max() <= piece and (np.diff(ia) >= 0).all() and (np.diff(jb) >= 0).all()


def test_no_tokens(spark, empty_frame):
    assert T.link_counts(empty_frame).count() == 0
    bad = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text UNION ALL SELECT 2L, 'ok' UNION ALL SELECT NULL, NULL")
    rows = {r.doc_id: tuple(r)[1:] for r in T.link_counts(bad).collect()}
    assert rows[1] == rows[None] == (0, 0, 0, 0, 0, 0, "") and rows[2][0] > 0


def test_fast_encoder_equals_the_library(spark):
    enc, _ = T.tokenizer_a(T.A_FILE)
    slow = T._tokenizers(T.A_FILE)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert enc(" " + r.text) == slow(" " + r.text)
