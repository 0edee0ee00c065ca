"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed greedily into factors, each a copy of a stretch of earlier text
(a smaller doc_id, or an earlier start in the same document). The reference is the corpus
itself in blocks, and every block is indexed:

1. *Seeds.* Each window of ``window`` words has one seed: the smallest hash among the
   ``seed_words``-word grams inside it. Equal windows have equal seeds, so a window whose
   seed occurs once in the corpus is not repeated. Blocks send their distinct seeds.
2. *Index.* Windows with a repeated seed are looked up by a 128-bit key. Copies inside
   a block point to the block's first; that first asks the index, which answers with the
   first of the corpus. So each window knows an earlier source, or that it is the first.
3. *Parse.* From a window with a source, the factor is extended as long as the next
   window continues the same source. At the factor's end the windows that straddle the
   boundary are looked up in turn, so a repeat cut by the greedy choice is still found.

Each factor of at least ``window`` words is a duplicate span; the words covered by spans
are removed. Windows are judged on the input, not on what is left. Two different windows
are taken as equal only if two independent 64-bit hashes of theirs agree.

Defined cases: null text has no words and an empty kept text; rows with one doc_id
compare by start position only, so repeated rows do not remove each other; a null doc_id
sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm import hashing as H
from caseflow.llm.blocks import NULL_KEY, Blocks, answer, discard, numpy_of, pack, release, split_by_part, written

SCHEMA = ("doc_id long, n_words long, n_removed long, kept_sha256 string, "
          "factors array<struct<start: long, length: long, ref_doc: long, ref_start: long>>")


def _windows(t, window: int, seed_words: int):
    """Valid window starts with their seeds and word hashes."""
    start, end, word_off = H.words(t.buf, t.off)
    h = H.word_hash(t.buf, start, end)
    at = H.inside_row(word_off, len(h), window)
    grams = H.gram_hash(h, seed_words, 1)
    seed = H.sliding_min(grams, window - seed_words + 1)[at] if len(at) else grams[:0]
    return at, seed, h, start, end, word_off


def _first_of(doc, pos, *keys):
    """For each element, the index of the (doc, pos)-smallest element with the same keys."""
    order = np.lexsort((pos, doc, *keys))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.empty(len(order), np.int64)
    out[order] = lead
    return out


def _runs(*arrays):
    """Starts of maximal stretches in which every array rises by one per step."""
    new = np.ones(len(arrays[0]), bool)
    new[1:] = np.logical_or.reduce([np.diff(a) != step for a, step in arrays[1:]]) | (np.diff(arrays[0]) != 1)
    return np.flatnonzero(new)


def factorise(pos, ref_doc, ref_pos, window: int):
    """Greedy factors from the windows of one document that have a source, in order of
    ``pos``: arrays (start, length, ref_doc, ref_start). A factor grows while the next
    window copies the next stretch of the same source; the next factor starts at the first
    window behind it, which may straddle its end."""
    if not len(pos):
        return (np.zeros(0, np.int64),) * 4
    cut = _runs(pos, (ref_doc, 0), (ref_pos, 1))
    size = np.diff(np.append(cut, len(pos))) + window - 1
    return pos[cut], size, ref_doc[cut], ref_pos[cut]


def parse(docs: DataFrame, window: int = 20, seed_words: int = 8) -> DataFrame:
    """One row per row of ``docs``: SCHEMA. ``factors`` is the parse (copies only)."""
    store = Blocks(docs)
    n_parts = store.n_parts

    def seeds(t, block):
        at, seed, h, *_ = _windows(t, window, seed_words)
        distinct = np.unique(seed)
        grams = H.gram_hash(h, seed_words, 1) if len(at) else seed
        place = np.minimum(np.searchsorted(distinct, grams), max(len(distinct) - 1, 0))
        many = np.bincount(place[distinct[place] == grams], minlength=len(distinct)) > 1
        for p, i in split_by_part(H.part_of(H.mix(distinct), n_parts), n_parts):
            yield p, pack(seed=distinct[i], many=many[i])

    def repeated(got):
        seed = np.concatenate([numpy_of(t, "seed") for _, t in got])
        many = np.concatenate([t.column("many").to_numpy(zero_copy_only=False) for _, t in got])
        once, inv, count = np.unique(seed, return_inverse=True, return_counts=True)
        hit = ((count > 1) | (np.bincount(inv, many, len(once)) > 0))[inv]
        at = 0
        for block, t in got:
            keep = hit[at:at + len(t)]
            at += len(t)
            if keep.any():
                yield block, pack(seed=numpy_of(t, "seed")[keep])

    def ask(t, replies, block):
        seeds = np.sort(np.concatenate([numpy_of(r, "seed") for r in replies])) if replies else np.zeros(0, np.uint64)
        at, seed, h, _, _, word_off = _windows(t, window, seed_words)
        at = at[H.member(seed, seeds)]
        if not len(at):
            return
        k1, k2 = H.gram_hash(h, window, 2)[at], H.gram_hash(h, window, 3)[at]
        row = H.row_of(word_off, len(h))[at]
        pos, doc = at - word_off[row], t.ids[row]
        lead = _first_of(doc, pos, k1, k2)
        own = (doc[lead] != doc) | (pos[lead] != pos)  # an earlier source in this block
        cut = np.flatnonzero(own)
        cut = cut[_runs(at[cut], (doc[lead[cut]], 0), (pos[lead[cut]], 1))] if len(cut) else cut
        starts = np.zeros(len(at), bool)
        starts[cut] = True
        run = np.cumsum(starts) - 1
        size = np.bincount(run[own], minlength=len(cut)) if len(cut) else np.zeros(0, np.int64)
        if len(cut):
            yield block % n_parts, pack(row=row[cut].astype(np.int32), pos=pos[cut].astype(np.int32),
                                        ref_doc=doc[lead[cut]], ref_pos=pos[lead[cut]].astype(np.int32),
                                        n=size.astype(np.int32))
        first = np.flatnonzero(lead == np.arange(len(at)))
        for p, i in split_by_part(H.part_of(k1[first], n_parts), n_parts):
            i = first[i]
            yield p, pack(k1=k1[i], k2=k2[i], doc=doc[i], pos=pos[i].astype(np.int32), row=row[i].astype(np.int32))

    def first_sources(got):
        for block, t in got:
            if "n" in t.column_names:  # found in the block already; goes straight back
                yield block, pack(**{c: t.column(c).combine_chunks() for c in t.column_names})
        got = [(b, t) for b, t in got if "k1" in t.column_names]
        if not got:
            return
        col = {c: np.concatenate([numpy_of(t, c) for _, t in got]) for c in ("k1", "k2", "doc", "pos", "row")}
        lead = _first_of(col["doc"], col["pos"], col["k1"], col["k2"])
        late = (col["doc"][lead] != col["doc"]) | (col["pos"][lead] != col["pos"])
        at = 0
        for block, t in got:
            i = at + np.flatnonzero(late[at:at + len(t)])
            at += len(t)
            if len(i):
                yield block, pack(row=col["row"][i], pos=col["pos"][i], ref_doc=col["doc"][lead[i]],
                                  ref_pos=col["pos"][lead[i]], n=np.ones(len(i), np.int32))

    def cut_spans(t, replies):
        start, end, word_off = H.words(t.buf, t.off)
        c = {k: (np.concatenate([numpy_of(r, k) for r in replies]).astype(np.int64) if replies
                 else np.zeros(0, np.int64)) for k in ("row", "pos", "ref_doc", "ref_pos", "n")}
        step = np.arange(c["n"].sum()) - np.repeat(np.cumsum(c["n"]) - c["n"], c["n"])
        e = {k: np.repeat(c[k], c["n"]) for k in ("row", "pos", "ref_doc", "ref_pos")}
        e["pos"], e["ref_pos"] = e["pos"] + step, e["ref_pos"] + step
        order = np.lexsort((e["pos"], e["row"]))
        e = {k: v[order] for k, v in e.items()}
        bound = np.searchsorted(e["row"], np.arange(t.n + 1))
        n_words, n_removed, sha, factors = [], [], [], []
        for i in range(t.n):
            a, b = word_off[i], word_off[i + 1]
            own = slice(bound[i], bound[i + 1])
            f = factorise(e["pos"][own], e["ref_doc"][own], e["ref_pos"][own], window)
            mark = np.zeros(b - a + 1, np.int64)
            np.add.at(mark, f[0], 1)
            np.add.at(mark, f[0] + f[1], -1)
            kept = a + np.flatnonzero(np.cumsum(mark[:-1]) == 0)
            n_words.append(b - a)
            n_removed.append(b - a - len(kept))
            sha.append(hashlib.sha256(join_words(t.buf, start, end, kept)).hexdigest())
            factors.append([{"start": w, "length": x, "ref_doc": None if y == NULL_KEY else y, "ref_start": z}
                            for w, x, y, z in zip(*(v.tolist() for v in f))])
        return {"doc_id": t.keys, "n_words": n_words, "n_removed": n_removed, "kept_sha256": sha, "factors": factors}

    scratch: list[str] = []
    known = written(answer(store.ask(seeds), repeated), "rlz-seeds", scratch)
    release(store.spark)
    out = written(store.settle(answer(store.ask_again(known, ask), first_sources), cut_spans, SCHEMA), "rlz-parse")
    store.drop()
    discard(store.spark, scratch)
    return out


def join_words(buf, start, end, which) -> bytes:
    """The chosen words joined by one space each."""
    raw = memoryview(buf)
    return b" ".join([raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())])


def op1_rlz_dedup(spark, sf_dir: str) -> DataFrame:
    """Words covered by a 20-word window that starts earlier in the corpus, per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return parse(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
