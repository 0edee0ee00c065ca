"""N-gram scoring with Katz backoff.

Counts of all orders are learned from the training documents; counts up to ``CUT`` get
Good-Turing discounts, and the mass they free backs off to the next lower order with
weights that make every distribution sum to one:

    P(w | h) = d(c) c(h w) / (c(h) + 1)            if c(h w) > 0
             = a(h) P(w | h without its first word) otherwise
    a(h)     = (1 - sum of P(w | h) over seen w) / (1 - sum of the lower P(w) over seen w)

(the further 1 in each denominator keeps some mass for unseen words even after histories
whose counts are all above ``CUT``). Below the words stands one class for all unknown words,
with the mass that the discounted unigrams leave.

Count tables are partitioned: one order after the other, every block sends its distinct
n-grams with their training counts to the partition of their history, which adds them up and
answers with the counts of the corpus and, for histories of n-grams that were never seen,
with what a(h) needs. N-grams of histories so frequent that one partition would hold too
many are dealt by the whole n-gram, and their sums are added up afterwards. The answers,
stored by block, are then evaluated recursively for each token. N-grams are told apart by
64-bit hashes.

Defined cases: null text is empty and consists of the end token; a null doc_id counts as
an empty string for the split; without training tokens every score is null. Extra columns
are ignored; repeated rows are counted and scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import hashing as H
from caseflow.llm.blocks import Blocks, answer, bodies, discard, numpy_of, pack, release, split_by_part, unpack, written

CUT = 5  # counts above are not discounted
END = np.uint64(0x51ED270B7F4A9C35)
BLOCK_BYTES = 6 << 20
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def good_turing(n: list[int]) -> np.ndarray:
    """Discount factors d[0..CUT] from the numbers n[r] of n-grams seen r times (r to CUT + 1).

    Katz's form where it gives factors in (0, 1]; else (small or odd samples) half a count off."""
    d = np.ones(CUT + 1)
    if n[1] > 0:
        cut = (CUT + 1) * n[CUT + 1] / n[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            for r in range(1, CUT + 1):
                d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut != 1 else np.nan
    if n[1] == 0 or not np.all((d[1:] > 0) & (d[1:] <= 1)):
        d[1:] = 1 - 0.5 / np.arange(1, CUT + 1)
    return d


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c <= CUT, d[np.minimum(c, CUT)], 1.0) * c


class Tokens:
    """The tokens of a block: hashes ``h``, row ``i`` holding off[i]:off[i+1], the last one END."""

    def __init__(self, t, modulus: int):
        buf = t.buf + ((t.buf >= 65) & (t.buf <= 90)).astype(np.uint8) * np.uint8(32)
        start, end, word_off = H.words(buf, t.off)
        self.off = word_off + np.arange(t.n + 1)
        self.h = np.full(self.off[-1], END)
        is_end = np.zeros(len(self.h), bool)
        is_end[self.off[1:] - 1] = True
        self.h[~is_end] = H.word_hash(buf, start, end, 21)
        self.held = H.crc_mod(t.keys.to_pylist(), modulus) == 0
        row = np.repeat(np.arange(t.n), np.diff(self.off))
        self.train = ~self.held[row]
        self.row, self.place = row, np.arange(len(self.h)) - self.off[row]

    def grams(self, n: int):
        """Tokens with at least n - 1 before them: (their numbers, n-gram keys, history keys)."""
        at = np.flatnonzero(self.place >= n - 1)
        if n == 1:
            return at, self.h, np.zeros(len(at), np.uint64)
        hist = H.gram_hash(self.h, n - 1, 22)[at - n + 1] if n > 2 else self.h[at - 1]
        return at, H.gram_hash(self.h, n, 22)[at - n + 1], hist


def distinct(key, hist, *weights):
    """Distinct n-grams in order of (history, n-gram): (key, hist, index per token, summed weights)."""
    order = np.lexsort((key, hist))
    k, g = key[order], hist[order]
    new = np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return k[first], g[first], index, *(np.bincount(index, w, len(first)).astype(np.int64) for w in weights)


class Level:
    """What is known of one order after its counts are in: discounts and frequent histories."""

    def __init__(self, order: int, n_of: list[int], tokens: int, frequent: dict):
        self.order, self.d, self.tokens = order, good_turing(n_of), tokens
        self.types = None
        self.n_of = n_of
        keys = sorted(frequent)
        self.hot = np.array(keys, np.uint64)
        self.hot_freed = np.array([self.freed(np.array(frequent[k][0])) for k in keys], float)
        self.hot_low = np.array([frequent[k][1] for k in keys], float)

    def freed(self, m) -> np.ndarray:
        """Counts freed by discounting m[..., r-1] types seen r times, and the further one."""
        return 1 + (np.asarray(m) * (1 - self.d[1:]) * np.arange(1, CUT + 1)).sum(-1)


def route(hist_count, frequent: int, key, hist, order: int, n_parts: int):
    """Partition of each n-gram, and whether its history is dealt by n-gram."""
    if order == 1:
        return H.part_of(key, n_parts), np.zeros(len(key), bool)
    hot = hist_count > frequent
    return H.part_of(H.mix(np.where(hot, key, hist)), n_parts), hot


def evaluate(tok: Tokens, replies, levels, n_parts: int, frequent: int):
    """Per token, for the orders answered so far: (probability, count as an n-gram, per order counts)."""
    by_order: dict[int, list] = {}
    for r in replies:
        by_order.setdefault(int(r.column("order")[0].as_py()), []).append(r)
    prob = count = None
    counts = []
    for level in levels:
        n = level.order
        at, key, hist = tok.grams(n)
        key, hist, index = distinct(key, hist)
        known = np.zeros(len(key), np.int64)
        if n > 1:
            first = np.zeros(len(key), np.int64)
            first[index] = at
            hist_count = count[first - 1]  # how often the history was seen, an n-gram one order lower
        else:
            hist_count = None
        part, _ = route(hist_count, frequent, key, hist, n, n_parts)
        got = by_order.get(n, [])
        sent = {p: i for p, i in split_by_part(part, n_parts)}
        freed = {}
        for r in got:
            if "c" in r.column_names:
                known[sent[r.column("part")[0].as_py()]] = numpy_of(r, "c")
            else:
                m = np.stack([numpy_of(r, f"m{i}") for i in range(1, CUT + 1)], 1)
                freed.update(zip(numpy_of(r, "hist").tolist(), zip(level.freed(m).tolist(), numpy_of(r, "low").tolist())))
        c = known[index]
        if n == 1:
            unknown = float(level.freed(np.array(level.n_of[1:CUT + 1]))) / (level.tokens + 1)
            prob = np.where(c > 0, discounted(level.d, c) / (level.tokens + 1), unknown)
            count = c
        else:
            hc = hist_count[index]
            seen = c > 0
            p = prob.copy()
            p[at[seen]] = discounted(level.d, c[seen]) / (hc[seen] + 1)
            back = np.flatnonzero(~seen & (hc > 0))
            if len(back):
                h = hist[index[back]]
                f = np.array([freed.get(x, (np.nan, np.nan)) for x in h.tolist()])
                hot = H.member(h, level.hot)
                if hot.any():
                    j = np.searchsorted(level.hot, h[hot])
                    f[hot, 0], f[hot, 1] = level.hot_freed[j], level.hot_low[j]
                p[at[back]] = f[:, 0] / (hc[back] + 1) / (1 - f[:, 1]) * prob[at[back]]
            prob = p
            count = np.zeros(len(tok.h), np.int64)
            count[at] = c
        counts.append(count)
    return prob, count, counts


def score(docs: DataFrame, order: int = 2, modulus: int = 10, smoothing: float = 0.1,
          frequent: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): SCHEMA. Training documents are those whose
    crc32(doc_id as text) mod ``modulus`` is not 0. Histories seen more often than
    ``frequent`` times (unset: a quarter of a partition's share of the tokens, 1000 at least)
    are dealt by n-gram."""
    store = Blocks(docs, BLOCK_BYTES)
    n_parts, levels, replies = store.n_parts, [], None
    scratch: list[str] = []

    def limit(known) -> int:
        return 0 if not known else frequent or max(known[0].tokens // (4 * n_parts), 1000)

    def requests(n: int, known: list):
        def ask(t, replies, block):
            tok = Tokens(t, modulus)
            prob, count, _ = evaluate(tok, replies, known, n_parts, limit(known)) if known else (None, None, None)
            at, key, hist = tok.grams(n)
            key, hist, index, c = distinct(key, hist, tok.train[at])
            first = np.zeros(len(key), np.int64)
            first[index] = at
            part, hot = route(count[first - 1] if n > 1 else None, limit(known), key, hist, n, n_parts)
            for p, i in split_by_part(part, n_parts):
                cols = {"key": key[i], "c": c[i].astype(np.int32)}
                if n > 1:
                    cols |= {"hist": hist[i], "low": _coded(prob[first[i]]), "hot": hot[i]}
                yield p, pack(**cols, part=np.full(len(i), p, np.int32))
        return ask

    def add_up(n: int):
        def run(got):
            c = np.concatenate([numpy_of(t, "c") for _, t in got]).astype(np.int64)
            key = np.concatenate([numpy_of(t, "key") for _, t in got])
            hist = (np.concatenate([numpy_of(t, "hist") for _, t in got]) if n > 1 else np.zeros(len(key), np.uint64))
            k, g, index, total = distinct(key, hist, c)
            seen = np.flatnonzero(total > 0)
            n_of = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
            yield -1, pack(order=np.full(1, n), n_of=pa.array([n_of.tolist()]), tokens=np.array([total.sum()]),
                           types=np.array([len(seen)]))
            stats = None
            if n > 1 and len(k):
                low, hot = np.zeros(len(k)), np.zeros(len(k), bool)
                low[index] = np.concatenate([t.column("low").cast(pa.float64()).to_numpy() for _, t in got])
                hot[index] = np.concatenate([t.column("hot").to_numpy(zero_copy_only=False) for _, t in got])
                names, of = np.unique(g, return_inverse=True)
                m = np.stack([np.bincount(of[seen], total[seen] == r, len(names)) for r in range(1, CUT + 1)], 1)
                low = np.bincount(of[seen], low[seen], len(names))
                is_hot = np.zeros(len(names), bool)
                is_hot[of[hot]] = True
                stats = names, m.astype(np.int64), low, is_hot
                yield from ((-2, _stats(names, m, low, is_hot, n)) for _ in range(1) if is_hot.any())
            at = 0
            for block, t in got:
                i = index[at:at + len(t)]
                at += len(t)
                part = t.column("part")[0].as_py()
                yield block, pack(c=total[i].astype(np.int32) if total.max(initial=0) < 1 << 31 else total[i],
                                  order=np.full(len(i), n, np.int8), part=np.full(len(i), part, np.int32))
                if stats:
                    names, m, low, is_hot = stats
                    need = np.zeros(len(names), bool)
                    need[np.searchsorted(names, g[i[total[i] == 0]])] = True
                    need &= ~is_hot
                    if need.any():
                        yield block, _stats(names, m, low, need, n)
        return run

    for n in range(1, order + 1):
        asked = store.ask_again(replies, requests(n, list(levels))) if n > 1 else store.ask(
            lambda t, block, f=requests(1, []): f(t, [], block))
        new = written(answer(asked, add_up(n)), f"katz-{n}", scratch)
        totals = [0] * (CUT + 3), 0, 0
        for r in new.where("block = -1").select("body").toLocalIterator():
            s = unpack(r["body"]).to_pylist()[0]
            totals = [a + b for a, b in zip(totals[0], s["n_of"])], totals[1] + s["tokens"], totals[2] + s["types"]
        level = Level(n, totals[0], totals[1], _frequent(new))
        level.types = totals[2]
        levels.append(level)
        replies = new.where("block >= 0") if replies is None else replies.unionByName(new.where("block >= 0"))
        release(store.spark)

    def judge(t, replies):
        tok = Tokens(t, modulus)
        prob, _, counts = evaluate(tok, replies, levels, n_parts, limit(levels))
        total, types = levels[0].tokens, levels[0].types
        base = np.log10((counts[0] + smoothing) / (total + smoothing * (types + 1)))
        sums = lambda x: np.bincount(tok.row, x, t.n)
        none = total == 0
        return {"doc_id": t.keys, "held_out": tok.held, "n_tokens": np.diff(tok.off),
                "n_known": sums(counts[0] > 0).astype(np.int64), "train_tokens": np.full(t.n, total),
                "base_score": [None] * t.n if none else sums(base),
                "score": [None] * t.n if none else sums(np.log10(prob))}

    out = written(store.settle(replies, judge, SCHEMA), "katz-scores")
    store.drop()
    discard(store.spark, scratch)
    return out


def _coded(x: np.ndarray) -> pa.Array:
    """Few different values, many times: as places in a list of the values."""
    values, at = np.unique(x, return_inverse=True)
    return pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int16 if len(values) < 1 << 15 else np.int32)), pa.array(values))


def _stats(names, m, low, which, n):
    return pack(hist=names[which], **{f"m{r}": m[which, r - 1].astype(np.int64) for r in range(1, CUT + 1)},
                low=low[which], order=np.full(int(which.sum()), n, np.int8))


def _frequent(replies: DataFrame) -> dict:
    """Sums of the histories that were dealt by n-gram; there are at most 4 per partition."""
    cols = ["hist", *(f"m{r}" for r in range(1, CUT + 1)), "low"]

    def rows(batches):
        for b in batches:
            for t in bodies(pa.Table.from_batches([b])):
                t = t.select(cols)
                t = t.set_column(0, "hist", pa.array(numpy_of(t, "hist").view(np.int64)))
                yield from t.to_batches()
    flat = replies.where("block = -2").select("body").mapInArrow(
        rows, "hist long, " + ", ".join(f"m{r} long" for r in range(1, CUT + 1)) + ", low double")
    summed = flat.groupBy("hist").agg(*[F.sum(c).alias(c) for c in cols[1:]])
    return {r["hist"] % (1 << 64): ([r[c] for c in cols[1:-1]], r["low"]) for r in summed.collect()}


def op4_katz(spark, sf_dir: str) -> DataFrame:
    """Bigram Katz scores of all documents, learned from nine tenths of them."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
