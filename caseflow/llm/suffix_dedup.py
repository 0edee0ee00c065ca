"""Suffix-array dedup with deep-shallow sorting.

A byte is a duplicate if some ``window``-byte string over it also starts in a document
with a smaller doc_id. Such strings are neighbours in the sorted order of all suffixes,
so the suffixes are sorted to that depth, in key partitions:

1. *Seeds.* Each window has one seed: the smallest hash among the ``gram``-byte strings
   inside it. Equal windows have equal seeds, so suffixes whose seed is in one document
   only need no sorting. Blocks send their distinct seeds with document counts.
2. *Runs.* Neighbouring windows with the same repeated seed form a run, sent as its bytes
   (a few more than ``window``). Runs with equal bytes in a block collapse to the one with
   the smallest doc_id. Seeds in many documents send each window by its own hash instead,
   so that no partition holds all the runs of a frequent passage.
3. *Sort.* ``deep_shallow`` sorts the suffixes of a partition: multikey quicksort on
   8-byte characters down to a shallow depth; then blind tries, which compare each suffix
   of a group with one representative, branch at the first mismatch and never read a
   branch's prefix again. Suffixes equal to the full window depth form a class, and those
   with a larger doc_id than the class's smallest are duplicates.

Defined cases: null text counts as empty; rows that share a doc_id do not remove each
other; a null doc_id sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from caseflow.llm import hashing as H
from caseflow.llm.blocks import Blocks, answer, discard, numpy_of, pack, release, split_by_part, written

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"
SLICE = 1 << 19


# ------------------------------------------------------------------ deep-shallow sorting
def _chars(buf: np.ndarray) -> np.ndarray:
    """At each position, the eight bytes from there as one big-endian character."""
    out = np.zeros(len(buf), np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out[:len(buf) - j] |= buf[j:]
    return out


def _groups(*keys) -> np.ndarray:
    """Group number per element of sorted key arrays."""
    new = np.zeros(len(keys[0]), np.int64)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.cumsum(new)


def deep_shallow(buf: np.ndarray, at: np.ndarray, depth: int, shallow: int = 16):
    """Sort the suffixes of ``buf`` that start at ``at`` by their first ``depth`` bytes.

    Returns (order, class): the sorted order of ``at`` and, per element of ``at``, the number
    of its class of suffixes equal to that depth, rising in sorted order. ``buf`` must
    reach ``depth`` + 8 bytes past every start."""
    n, chars = len(at), _chars(buf)
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)  # places in `order` that still share a group
    d = 0
    while d < min(shallow, depth) and len(live):  # multikey quicksort, one character a level
        key = chars[at[order[live]] + d]
        if depth - d < 8:
            key >>= np.uint64(8 * (8 - (depth - d)))
        by = np.lexsort((key, group[live]))
        order[live] = order[live][by]
        key = key[by]
        # `live` is in order of group, and so are its places: groups stay where they are
        sub = _groups(group[live], key)
        first = np.flatnonzero(np.append(True, sub[1:] != sub[:-1]))
        group[live] = live[first][sub]  # a group is named by its first place
        size = np.diff(np.append(first, len(live)))
        live = live[np.repeat(size > 1, size)]
        d += 8
    if d < depth and len(live):
        _blind_tries(buf, chars, at, order, group, live, d, depth)
    cls = np.empty(n, np.int64)
    cls[order] = _groups(group) if n else group
    return order, cls


def _blind_tries(buf, chars, at, order, group, live, d, depth) -> None:
    """Order the groups at places ``live``, which agree on their first ``d`` bytes.

    All groups grow their tries together. In each round the first suffix of every group is
    its representative; the others find their branch below it: the depth of the first
    mismatch and the byte there. Suffixes on one branch agree up to and including
    that byte and form the next round's group."""
    known = np.full(len(live), d)
    while len(live):
        g = group[live]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        rep = np.repeat(first, np.diff(np.append(first, len(live))))
        mine, reps = at[order[live]], at[order[live[rep]]]
        branch, byte = np.full(len(live), depth), np.zeros(len(live), np.int64)
        open_ = np.arange(len(live))
        for j in range(int(known.min()), depth, 8):  # compare below the representative
            a, b = chars[mine[open_] + j], chars[reps[open_] + j]
            off = open_[a != b]
            if len(off):
                i = np.arange(8)
                diff = buf[mine[off, None] + j + i] != buf[reps[off, None] + j + i]
                branch[off] = np.minimum(j + diff.argmax(1), depth)
                open_ = open_[a == b]
        apart = branch < depth
        byte[apart] = buf[mine[apart] + branch[apart]]
        before = apart & (byte < buf[np.minimum(reps + branch, len(buf) - 1)])
        # in the trie: smaller branches, the shallowest first; the representative's class; larger, deepest first
        side = np.where(before, 0, np.where(apart, 2, 1))
        level = np.where(before, branch, np.where(apart, -branch, 0))
        by = np.lexsort((byte, level, side, g))
        order[live] = order[live][by]
        sub = _groups(g, side[by], level[by], byte[by])
        start = np.flatnonzero(np.append(True, sub[1:] != sub[:-1]))
        group[live] = live[start][sub]
        size = np.diff(np.append(start, len(live)))
        again = np.repeat(size > 1, size) & apart[by]
        known = (branch[by] + 1)[again]
        live = live[again]


# ------------------------------------------------------------------ windows and seeds
def _window_seeds(buf, off, window: int, gram: int):
    """Slices of the window starts that stay in one row: (starts, their seeds). Starts in
    different rows are never neighbours."""
    for a in range(0, len(buf) - window + 1, SLICE):
        b = min(a + SLICE, len(buf) - window + 1)
        grams = H.gram_hash(H._table(11)[buf[a:b + window - 1]], gram, 11)
        seed = H.sliding_min(grams, window - gram + 1)
        ok = np.ones(b - a, bool)
        for z in off[np.searchsorted(off, a, "right"):np.searchsorted(off, b + window)].tolist():
            ok[max(z - window + 1 - a, 0):max(z - a, 0)] = False
        at = np.flatnonzero(ok)
        yield at + a, seed[at]


def _padded(buf: np.ndarray, window: int) -> np.ndarray:
    return np.append(buf, np.zeros(window + 8, np.uint8))


def _run_matrix(buf, at, size, wide):
    """Rows of ``wide`` bytes and filling: ``size`` bytes from each start, zeros, and the size."""
    grid = np.zeros((len(at), -(-(wide + 4) // 8) * 8), np.uint8)
    grid[:, :wide] = buf[np.minimum(at[:, None] + np.arange(wide), len(buf) - 1)]
    grid[:, :wide][np.arange(wide) >= size[:, None]] = 0
    grid[:, -4:] = size.astype("<u4").view(np.uint8).reshape(-1, 4)
    return grid


def _smallest_equal(matrix: np.ndarray, doc: np.ndarray):
    """Per row, a row with the same bytes and the smallest doc: rows are put in order of a
    hash, then compared byte by byte with the first of their hash."""
    rows = matrix.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = H.mix(h + rows[:, j])
    order = np.lexsort((doc, h))
    same = h[order][1:] == h[order][:-1]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0))]
    return np.where((rows[lead] == rows).all(1), lead, np.arange(len(order)))


def duplicate_bytes(docs: DataFrame, window: int = 50, gram: int = 16, frequent: int = 2000) -> DataFrame:
    """One row per row of ``docs``: SCHEMA; ``spans`` are the maximal removed byte runs. The windows
    of seeds in more than ``frequent`` documents are dealt one by one."""
    store = Blocks(docs)
    n_parts, most = store.n_parts, 2 * window - gram

    def seeds(t, block):
        found = []
        for at, seed in _window_seeds(t.buf, t.off, window, gram):
            new = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (np.diff(at) != 1))[:len(at)])
            found.append((seed[new], t.ids[np.searchsorted(t.off, at[new], "right") - 1]))
        if not found:
            return
        seed, doc = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc, seed))
        seed, doc = seed[order], doc[order]
        first = np.append(True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])) if len(seed) else np.zeros(0, bool)
        distinct, count = np.unique(seed[first], return_counts=True)
        for p, i in split_by_part(H.part_of(H.mix(distinct), n_parts), n_parts):
            yield p, pack(seed=distinct[i], docs=count[i].astype(np.int32))

    def repeated(got):
        seed = np.concatenate([numpy_of(t, "seed") for _, t in got])
        count = np.concatenate([numpy_of(t, "docs") for _, t in got])
        once, inv = np.unique(seed, return_inverse=True)
        total = np.bincount(inv, count, len(once))[inv]
        at = 0
        for block, t in got:
            here = slice(at, at + len(t))
            at += len(t)
            keep = total[here] > 1
            if keep.any():
                yield block, pack(seed=seed[here][keep], frequent=(total[here] > frequent)[keep])

    def runs(t, replies, block):
        if not replies:
            return
        known = np.concatenate([numpy_of(r, "seed") for r in replies])
        often = np.concatenate([r.column("frequent").to_numpy(zero_copy_only=False) for r in replies])
        order = np.argsort(known)
        known, often = known[order], often[order]
        found = []
        for at, seed in _window_seeds(t.buf, t.off, window, gram):
            first = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (np.diff(at) != 1))[:len(at)])
            size = np.diff(np.append(first, len(at)))
            hit = H.member(seed[first], known)
            at, seed, size = at[first[hit]], seed[first[hit]], size[hit]
            if not len(at):
                continue
            # runs of frequent seeds are cut to single windows, others to the length of one gram's reach
            single = often[np.searchsorted(known, seed)]
            step = np.where(single, 1, most - window + 1)
            cuts = -(-size // step)
            of = np.repeat(np.arange(len(at)), cuts)
            shift = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * step[of]
            begin = at[of] + shift
            found.append((begin, np.minimum(step[of], size[of] - shift), seed[of],
                          np.searchsorted(t.off, begin, "right") - 1, single[of]))
        if not found:
            return
        at, n, seed, row, single = (np.concatenate(x) for x in zip(*found))
        matrix = _run_matrix(t.buf, at, n + window - 1, most)
        doc, pos = t.ids[row], at - t.off[row]
        lead = _smallest_equal(matrix, doc)
        late = doc[lead] < doc
        if late.any():
            yield block % n_parts, pack(row=row[late].astype(np.int32), pos=pos[late], n=n[late].astype(np.int32))
        ask = np.flatnonzero(~late)  # a run that returns in its own document is asked for at each place
        part = H.mix(seed[ask])
        alone = np.flatnonzero(single[ask])
        if len(alone):
            spans = at[ask[alone]]
            part[alone] = H.word_hash(t.buf, spans, spans + window, 12) if len(spans) else part[alone]
        for p, i in split_by_part(H.part_of(part, n_parts), n_parts):
            i = ask[i]
            body = b"".join([t.buf[a:b].tobytes() for a, b in zip(at[i], at[i] + n[i] + window - 1)])
            yield p, pack(doc=doc[i], pos=pos[i], row=row[i].astype(np.int32), n=n[i].astype(np.int32),
                          bytes=_binary(body, n[i] + window - 1))

    def sort_runs(got):
        for block, t in got:
            if "bytes" not in t.column_names:  # found in the block already; goes straight back
                yield block, pack(**{c: t.column(c).combine_chunks() for c in t.column_names})
        got = [(b, t) for b, t in got if "bytes" in t.column_names]
        if not got:
            return
        c = {k: np.concatenate([numpy_of(t, k) for _, t in got]) for k in ("doc", "pos", "row", "n")}
        buf = np.concatenate([_payload(t.column("bytes")) for _, t in got])
        size = c["n"].astype(np.int64) + window - 1
        begin = np.cumsum(size) - size
        lead = _smallest_equal(_run_matrix(buf, begin, size, most), c["doc"])
        one = np.flatnonzero(lead == np.arange(len(lead)))  # runs with different bytes
        of = np.repeat(one, c["n"][one])
        step = np.arange(len(of)) - np.repeat(np.cumsum(c["n"][one]) - c["n"][one], c["n"][one])
        _, cls = deep_shallow(_padded(buf, window), begin[of] + step, window)
        smallest = np.full(cls.max() + 1 if len(cls) else 0, np.iinfo(np.int64).max)
        np.minimum.at(smallest, cls, c["doc"][of])
        # a later copy of a run shares the classes of the run it equals
        low = np.empty(int(c["n"].sum()), np.int64)
        first = np.cumsum(c["n"]) - c["n"]
        low[first[of] + step] = smallest[cls]
        back = np.repeat(first[lead] - first, c["n"])
        low = low[np.arange(len(low)) + back]
        at = np.repeat(np.arange(len(lead)), c["n"])
        off = np.arange(len(low)) - first[at]
        block = np.repeat([b for b, _ in got], [len(t) for _, t in got])
        hit = np.flatnonzero(low < c["doc"][at])
        if not len(hit):
            return
        at, off = at[hit], off[hit]
        new = np.append(True, (np.diff(at) != 0) | (np.diff(off) != 1))
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(at)))
        at, off = at[start], off[start]
        owner = block[at]
        for b in np.unique(owner):
            i = owner == b
            yield int(b), pack(row=c["row"][at[i]], pos=c["pos"][at[i]] + off[i], n=length[i].astype(np.int32))

    def cut_spans(t, replies):
        c = {k: (np.concatenate([numpy_of(r, k) for r in replies]).astype(np.int64) if replies
                 else np.zeros(0, np.int64)) for k in ("row", "pos", "n")}
        mark = np.zeros(len(t.buf) + 1, np.int32)
        begin = t.off[c["row"]] + c["pos"]
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + c["n"] + window - 1, -1)
        gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
        out = {"doc_id": t.keys, "n_bytes": np.diff(t.off), "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        for i in range(t.n):
            a, b = t.off[i], t.off[i + 1]
            g = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            out["n_removed"].append(int(g.sum()))
            out["n_spans"].append(len(edge) // 2)
            out["kept_sha256"].append(hashlib.sha256(t.buf[a:b][~g]).hexdigest())
            out["spans"].append([{"start": x, "stop": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())])
        return out

    scratch: list[str] = []
    known = written(answer(store.ask(seeds), repeated), "suffix-seeds", scratch)
    release(store.spark)
    out = written(store.settle(answer(store.ask_again(known, runs), sort_runs), cut_spans, SCHEMA), "suffix-spans")
    store.drop()
    discard(store.spark, scratch)
    return out


def _binary(body: bytes, sizes: np.ndarray):
    import pyarrow as pa
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(body)])


def _payload(column) -> np.ndarray:
    out = []
    for c in column.chunks:
        _, off, data = c.buffers()
        o = np.frombuffer(off, np.int64, len(c) + 1, c.offset * 8)
        out.append(np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8))
    return np.concatenate(out)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes under a 50-byte string that also starts in a document with a smaller doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicate_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
