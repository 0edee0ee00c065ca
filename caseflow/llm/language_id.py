"""Language identification with a byte convolutional network.

The network reads fixed-length windows of UTF-8 bytes: filters of several widths over the
bytes, the maximum of each filter over the window, and a softmax. It is trained in numpy
on labelled text and applied in batches to every window of the whole text; a text's
probabilities are the mean over its windows, weighted by their bytes.

Training reads every window of every labelled text. The texts are dealt by hash into shards of
about SHARD windows, and the shards into rounds of 1, 4, 16 ... of them. In a round every task learns
from one shard, starting from the weights of the round before, and the weights that come out are
averaged, each counting as many times as its shard has windows. The first round goes over its shard
several times if that is small. Sums are taken over whole numbers, so that no order of rows or tasks
changes the network.

The score tells text in a learned language from noise: ``train`` sets the network's
``least_score`` from the scores of all texts it learned from, LEAST_SHARE of the way from chance to
the score that the texts of all but a thousandth of their bytes reach, so practically all clean text
passes. The targets are smoothed by SMOOTH, so that the network is not sure of what it never saw. A
network that learned little is little above chance and drops nothing.

Defined cases: null text, or text without a letter, is ``und`` with score 0; a null lang is
not learned from; without any labelled text everything is ``und``, and ``keep_recognised``
keeps all text with a letter. Of equally probable languages the first by name is taken; an empty
table gives no rows. Rows are judged by text
alone, so repeated rows agree; extra columns are kept by ``predict``.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from caseflow.llm.blocks import give_back
from caseflow.llm.text import fresh

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
LETTER = re.compile(r"[^\W\d_]")
UND = "und"
LEAST_SHARE = 0.4
SHARD = 1 << 14  # windows that a task learns from, about, between two averages of the weights
SMOOTH = 0.2  # share of a target that is spread over all languages
SLOWED = 50  # steps after which the learning rate has halved
FIRST_VISITS = 96_000  # windows that the first round visits at least, in at most 12 epochs
FIXED = 1 << 20  # weights are summed in whole numbers of this fraction
SLICE = 256  # texts of a batch that are Python objects at one time
SCORE_STEPS = 10_000  # scores are counted in steps of a ten-thousandth


class ByteNet:
    """Filters ``w[width][j]`` (256 x FILTERS: byte at offset j), their bias, and the output layer."""

    def __init__(self, classes: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.w = {k: r.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.least_score, self.windows_learnt = 0.0, 0

    def params(self) -> list:
        return [*self.w.values(), self.out, self.bias]

    def fit(self, parts, weights: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01) -> int:
        """``parts`` yields (x, y): windows (n, WINDOW) of bytes and class numbers, which are learned from
        part after part. Adam on the softmax loss; ``weights`` by class. Returns how many windows came."""
        r, params, seen = np.random.default_rng(5), self.params(), 0
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for x, y in parts:
            weight, seen = weights[y], seen + len(y)
            for _ in range(epochs):
                for at in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
                    t += 1
                    for i, (q, g) in enumerate(zip(params, self.gradient(x[at], y[at], weight[at]))):
                        m[i] = 0.9 * m[i] + 0.1 * g
                        v[i] = 0.999 * v[i] + 0.001 * g * g
                        q -= rate / (1 + t / SLOWED) * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        return seen

    def gradient(self, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list:
        """The gradient of the weighted loss of one batch, in the order of ``params``."""
        rows, unit = np.arange(len(b))[:, None], np.arange(FILTERS)[None]
        feats, where = [], []
        for k in WIDTHS:
            s = self.w[k][0][b[:, :WINDOW - k + 1]]
            for j in range(1, k):
                s += self.w[k][j][b[:, j:WINDOW - k + 1 + j]]
            best = s.argmax(1)
            where.append(best)
            feats.append(np.take_along_axis(s, best[:, None], 1)[:, 0])
        f = np.concatenate(feats, 1)
        p = softmax(f @ self.out + self.bias)
        p[np.arange(len(b)), y] -= 1 - SMOOTH
        p -= SMOOTH / len(self.classes)
        p *= (weight / len(b))[:, None].astype(np.float32)
        g_f = p @ self.out.T
        grads = []
        for i, k in enumerate(WIDTHS):
            part = g_f[:, i * FILTERS:(i + 1) * FILTERS].ravel()
            g = [np.bincount((b[rows, where[i] + j].astype(np.int64) * FILTERS + unit).ravel(), part, 256 * FILTERS)
                 for j in range(k)]
            grads.append(np.stack(g).reshape(k, 256, FILTERS).astype(np.float32))
        return [*grads, f.T @ p, p.sum(0)]

    def pairs(self) -> list:
        """The filters as tables over byte pairs, so that a width-4 filter takes two look-ups."""
        def two(a, b):
            return (a[:, None] + b[None]).reshape(65536, FILTERS)
        w = self.w
        return [two(w[2][0], w[2][1]), two(w[3][0], w[3][1]), w[3][2], two(w[4][0], w[4][1]), two(w[4][2], w[4][3])]

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Class probabilities of each window (n, WINDOW)."""
        t = np.ascontiguousarray(x.T)
        pair = t[:-1].astype(np.uint16) << 8 | t[1:]
        two, three_a, three_b, four_a, four_b = tables
        best = [np.full((len(x), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        for p in range(WINDOW - 1):
            np.maximum(best[0], two[pair[p]], out=best[0])
            if p < WINDOW - 2:
                np.maximum(best[1], three_a[pair[p]] + three_b[t[p + 2]], out=best[1])
            if p < WINDOW - 3:
                np.maximum(best[2], four_a[pair[p]] + four_b[pair[p + 2]], out=best[2])
        return softmax(np.concatenate(best, 1) @ self.out + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(data: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one filled with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def held_out(modulus: int = 4, remainder: int = 2):
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def train(docs: DataFrame, least: bool = True) -> ByteNet | None:
    """Fit on the rows of ``docs`` (doc_id, text, lang) that are not held out, all windows of all of
    them; without ``least``, no ``least_score`` is worked out."""
    known = (docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
             .select("doc_id", "text", "lang"))
    n = F.ceil(F.octet_length("text") / WINDOW)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(n).alias("n")).collect()}  # one row per language
    if not counts:
        return None
    net = ByteNet(sorted(counts))
    total = sum(counts.values())
    weights = np.array([total / counts[lang] / len(counts) for lang in net.classes])
    shards = -(-total // SHARD)
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))
    done, size = 0, 1
    while done < shards:  # every text is in one round
        size = min(size, shards - done)
        epochs = 1 if done else min(12, -(-FIRST_VISITS // min(total, SHARD)))
        some = known.where((slot >= done) & (slot < done + size))
        net = _round(some, net, weights, size, epochs, rate=0.003 if done else 0.01)
        done, size = done + size, size * 4
    if least:
        net.least_score = _least_score(known, net)
    return net


def _round(some: DataFrame, net: ByteNet, weights: np.ndarray, shards: int, epochs: int, rate: float) -> ByteNet:
    """One round: ``shards`` tasks learn from their share of ``some`` each, and their weights are averaged."""
    shared = some.sparkSession.sparkContext.broadcast((net, weights))  # fixed by the network's shape

    def learn(batches):
        start, weights = shared.value
        mine, number = copy.deepcopy(start), {c: i for i, c in enumerate(start.classes)}
        seen = mine.fit(_shard(batches, number), weights, epochs, rate=rate)
        if seen:
            flat = np.concatenate([q.ravel() for q in mine.params()]).astype(np.float64)
            sums = np.append(np.rint(flat * FIXED).astype(np.int64) * seen, seen)
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.int64()))], names=["sums"])
        give_back()

    # one task a shard, whose rows come in an order of their own, wherever they were stored
    dealt = (some.select("lang", F.col("text").cast("binary").alias("x"), F.xxhash64("text", "doc_id").alias("o"))
             .repartition(shards, "o").sortWithinPartitions("o", "lang", "x").select("lang", "x"))
    sums = (dealt.mapInArrow(learn, "sums array<long>").select(F.posexplode("sums").alias("i", "v"))
            .groupBy("i").agg(F.sum("v").alias("v")).collect())  # one row per weight
    if not sums:  # no text fell into this round
        return net
    flat = np.array([v for _, v in sorted(tuple(r) for r in sums)], np.float64)
    out, at = copy.deepcopy(net), 0
    out.windows_learnt += int(flat[-1])
    for q in out.params():
        q[...] = (flat[at:at + q.size] / FIXED / flat[-1]).reshape(q.shape)
        at += q.size
    shared.destroy()
    return out


def _shard(batches, number: dict):
    """The windows of a task's rows (lang, x) in parts of about SHARD: (windows, class numbers)."""
    x, y, n = [], [], 0
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = windows(data)
            for at in range(0, len(w), SHARD):
                x.append(w[at:at + SHARD])
                y.append(np.full(len(x[-1]), number[lang]))
                n += len(x[-1])
                if n >= SHARD * 2:
                    yield np.concatenate(x), np.concatenate(y)
                    x, y, n = [], [], 0
    if n:
        yield np.concatenate(x), np.concatenate(y)


def _least_score(known: DataFrame, net: ByteNet) -> float:
    """``least_score`` from the scores of all rows of ``known``, counted by bytes."""
    step = F.floor(F.col("score") * SCORE_STEPS).cast("int").alias("step")
    steps = sorted(tuple(r) for r in predict(known.select("text"), net).groupBy(step).agg(
        F.sum(F.octet_length("text"))).collect())  # at most one row per step
    below, reached = sum(n for _, n in steps) // 1000, 0.0
    for at, n in steps:
        reached, below = at / SCORE_STEPS, below - n
        if below < 0:
            break
    chance = 1 / len(net.classes)
    return chance + LEAST_SHARE * max(reached - chance, 0.0)


def predict(docs: DataFrame, net: ByteNet | None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and its probability, from ``text`` alone. Only the texts
    are sent to Python, and only the two new columns come back."""
    tables = net.pairs() if net else None
    shared = docs.sparkSession.sparkContext.broadcast((net, tables))  # a few MB, fixed by the network's shape

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net, tables = shared.value
        for texts in columns:
            yield judge(texts, net, tables)
            give_back()

    # inside, columns go by position: a clash of names with the two new ones is harmless
    at = [f"c{i}" for i in range(len(docs.columns))]
    text = F.col(at[docs.columns.index("text")]).cast("string")
    judged = F.arrow_udf(run, "lang string, score double", ArrowUDFType.SCALAR_ITER)(text)
    return (docs.toDF(*at).select("*", judged.alias("judged")).select(*at, "judged.lang", "judged.score")
            .toDF(*docs.columns, label, score))


def judge(texts: pa.Array, net: ByteNet | None, tables: list | None) -> pa.StructArray:
    """(lang, score) of each text. The texts become Python objects a few at a time, whatever a batch holds."""
    lang, prob = [UND] * len(texts), [0.0] * len(texts)
    known = []

    def letters():
        for at in range(0, len(texts), SLICE):
            for i, t in enumerate(texts.slice(at, SLICE).to_pylist(), at):
                if net and t is not None and LETTER.search(t):
                    known.append(i)
                    yield i, t.encode()

    total = np.zeros((len(texts), len(net.classes) if net else 1))
    for rows, owner in _stacked(letters()):
        p = net.probabilities(rows, tables)
        np.add.at(total, owner, p * np.maximum((rows != 0).sum(1, keepdims=True), 1))
    for i in known:
        p = total[i] / total[i].sum()
        best = int(p.argmax())
        lang[i], prob[i] = net.classes[best], float(p[best])
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(prob, pa.float64())], ["lang", "score"])


def _stacked(texts, limit: int = 4096):
    """Windows of many texts in stacks of about ``limit`` rows: (rows, owner of each row)."""
    rows, owner, n = [], [], 0
    for i, data in texts:
        w = windows(data)
        for a in range(0, len(w), limit):
            rows.append(w[a:a + limit])
            owner.append(np.full(len(rows[-1]), i))
            n += len(rows[-1])
            if n >= limit:
                yield np.concatenate(rows), np.concatenate(owner)
                rows, owner, n = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(owner)


def keep_recognised(docs: DataFrame, net: ByteNet | None, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with a language other than ``und`` at ``least_score`` or more, columns
    unchanged; without a network, those with a letter."""
    if net is None:
        return docs.where(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]"))
    lang, score = fresh(docs, "_lang"), fresh(docs, "_lang_score")
    judged = predict(docs, net, lang, score)
    return judged.where((F.col(lang) != UND) & (F.col(score) >= least_score)).select(*docs.columns)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.select("doc_id", "text", "lang"), least=False)
    return (predict(docs.select("doc_id", "text"), net)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))
