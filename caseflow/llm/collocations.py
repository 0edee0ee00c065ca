"""Phrase collocations, with Misra-Gries summaries to find what is frequent.

Texts are cut into pieces at punctuation and line ends and pieces into words; phrases of 1 to 4 words
are counted per language. A collocation is a phrase of two words or more that occurs at least
``least`` times; it is scored by how much of its parts' occurrences it makes up, at its worst cut,
and dropped if a longer one has nearly all its occurrences.

Nearly all phrases occur once or twice, so the first pass finds the few that can be frequent:

* texts are written as blocks. Each block sends its distinct phrases, as 32 bits of a hash with their
  counts, to the hash partition that the leading bits of the hash name. That is a summary of the
  block without error.
* a partition merges these summaries into one Misra-Gries summary: counts of equal phrases are added,
  and when there are more counters than its capacity, all are lowered by the largest count that does
  not fit. Each unit lowered takes capacity + 1 occurrences away, so what a phrase loses is less than
  mass / capacity. The capacity exceeds mass / ``least``, so every phrase of ``least`` occurrences has
  a counter left, whatever the order of merging; what has a counter that can still reach ``least``
  survives. Memory of a partition is its capacity, not its distinct phrases.
* each block gets back one bit for each phrase that it sent.

The second pass counts exactly: a block counts its own survivors by their words, and an ordinary
aggregate over (language, words) adds the blocks up. Phrases that shared the bits of a hash only
cost a count. All parts of a frequent phrase are frequent, so scores are joins over this table.

The capacity is derived from the mass; nothing is capped or sampled. A phrase that all texts hold is
one entry per block. Blocks and parts follow the number of bytes; with both growing, the entries that
one block sends one part get fewer: 32,000 on 0.5 GB, 120 on 1 TB at these sizes, which grow for more.

Defined cases: null lang is ``und``, and joins that of the same name; a null, empty or blank text has
no words. Rows count as often as they occur, whatever their doc_id. Ties of cuts go to the shortest
first part, ties of rank to the larger count, then the phrase in byte order. An empty table, or one
without frequent phrases, gives no rows. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import hashing as H
from caseflow.llm.blocks import discard, give_back, pack, unpack, written

LEAST, LONGEST, TOP, ABSORBED = 30, 4, 2000, 80
BLOCK, PART = 4 << 20, 32 << 20  # bytes of text of a block, and for each part
ROOM = 2  # capacity, as a multiple of mass / least
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = BREAK.copy()
BLANK[[0x20, 0x09]] = True
U = np.uint64


def blocks(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """(block, size, body): the languages and texts of ``docs``, packed as they are read."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                before = int(size[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(size, before + block_bytes, "right")))
                some = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([int(size[to - 1]) - before], pa.int64()),
                     pa.array([pack(lang=some.column(0), text=some.column(1).cast(pa.large_binary()))], pa.binary())],
                    names=["block", "size", "body"])
                number, at = number + 1, to
                give_back()
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, "block long, size long, body binary")


class Phrases:
    """The phrases of one block: for each size, where they start (as a word) and their hash."""

    def __init__(self, body, longest: int = LONGEST):
        rows = unpack(body).combine_chunks()
        self.langs = rows.column("lang").to_pylist()
        text = rows.column("text").chunk(0) if rows.num_rows else pa.array([], pa.large_binary())
        _, offsets, data = text.buffers()
        off = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
        buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
        self.start, self.end, word_off = H.words(self.buf, off - off[0], BLANK)
        h = H.word_hash(self.buf, self.start, self.end, 51)
        self.row = H.row_of(word_off, len(h))
        # words of one piece share a number: it grows at every break and with every text
        piece = self.row + np.cumsum(BREAK[self.buf], dtype=np.int32)[self.start] if len(h) else self.row
        named = {x: xxhash.xxh64_intdigest(x, 77) for x in set(self.langs)}
        salt = np.array([named[x] for x in self.langs] + [0], np.uint64)
        self.at, self.hash = [], []
        for k in range(1, longest + 1):
            at = np.flatnonzero(piece[:len(h) - k + 1] == piece[k - 1:]) if len(h) >= k else np.zeros(0, np.int64)
            g = H.gram_hash(h, k, 51 + k)[at]
            self.at.append(at.astype(np.int32)), self.hash.append(H.mix(g ^ salt[self.row[at]]))

    def names(self, bits: int):
        """Distinct hash prefixes of 32 + ``bits`` bits, in order, with their counts."""
        all_ = np.concatenate(self.hash)
        all_ >>= U(32 - bits)
        all_.sort()
        first = np.flatnonzero(np.append(True, all_[1:] != all_[:-1])[:len(all_)])
        return all_[first], np.diff(first, append=len(all_))

    def words_of(self, i: int, k: int) -> str:
        raw = self.buf[self.start[i]:self.end[i + k - 1]].tobytes()
        if b"\t" in raw or b"  " in raw:
            raw = b" ".join(x for x in raw.replace(b"\t", b" ").split(b" ") if x)
        return raw.decode(errors="replace")


def press(v: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte by byte of equal weight."""
    return pa.Codec("zstd", 1).compress(v.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpress(body: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd", 1).decompress(body, 4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


class Summary:
    """A mergeable Misra-Gries summary: at most ``capacity`` counters, after each merge."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting, self.n = [], 0

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Add another summary, which lost at most ``lost`` of any count."""
        self.waiting.append((keys, counts))
        self.n, self.lost = self.n + len(keys), self.lost + lost
        if self.n > self.capacity:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            low = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            some = counts > low
            keys, counts, self.lost = keys[some], counts[some] - low, self.lost + int(low)
        self.keys, self.counts = keys, counts

    def reaching(self, least: int) -> np.ndarray:
        """Keys, in order, whose count can be ``least`` or more."""
        self.settle()
        return self.keys[self.counts + self.lost >= least]


def _survivors(least: int, room: int):
    """(block, part, bits) for every batch of one part: which of its phrases can be frequent."""
    def run(table: pa.Table) -> pa.Table:
        sent = list(zip(*(table.column(c).to_pylist() for c in ("n", "keys", "counts"))))
        mass = pc.sum(table.column("mass")).as_py()
        summary = Summary(room * mass // least + 1)
        for n, keys, counts in sent:
            summary.merge(np.cumsum(unpress(keys, n), dtype=np.uint32), unpress(counts, n).astype(np.int64))
        found = summary.reaching(least)
        bits = [np.packbits(H.member(np.cumsum(unpress(keys, n), dtype=np.uint32), found)).tobytes() for n, keys, _ in sent]
        out = pa.table({"block": table.column("block"), "part": table.column("part"),
                        "bits": pa.array([pa.compress(b, "zstd", asbytes=True) for b in bits], pa.binary())})
        give_back()
        return out
    return run


COUNTED = "lang string, size int, phrase string, n long"


def _exact(bits: int):
    """Exact counts of a block's surviving phrases, and (size 0) of all its words, by language."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "size": pa.array([], pa.int32()),
                             "phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        p = Phrases(left.column("body")[0].as_buffer())
        names, _ = p.names(bits)
        edge = np.searchsorted(names >> U(32), np.arange((1 << bits) + 1, dtype=np.uint64))
        alive = np.zeros(len(names), bool)
        for part, body in zip(right.column("part").to_pylist(), right.column("bits").to_pylist()):
            n = int(edge[part + 1] - edge[part])
            raw = np.frombuffer(pa.decompress(body, -(-n // 8), "zstd", asbytes=True), np.uint8)
            alive[edge[part]:edge[part + 1]] = np.unpackbits(raw, count=n).astype(bool)
        names = names[alive]
        lang, size, phrase, count = [], [], [], []
        for k, (at, h) in enumerate(zip(p.at, p.hash), 1):
            some = H.member(h >> U(32 - bits), names)
            _, first, n = np.unique(h[some], return_index=True, return_counts=True)
            at = at[some][first].tolist()
            lang += [p.langs[r] for r in p.row[at].tolist()] if at else []
            size += [k] * len(at)
            phrase += [p.words_of(i, k) for i in at]
            count += n.tolist()
        words = dict.fromkeys(p.langs, 0)
        for x, n in zip(p.langs, np.bincount(p.row, minlength=len(p.langs)).tolist()):
            words[x] += n
        for x, n in words.items():
            lang.append(x), size.append(0), phrase.append(""), count.append(n)
        give_back()
        return pa.table({"lang": pa.array(lang, pa.string()), "size": pa.array(size, pa.int32()),
                         "phrase": pa.array(phrase, pa.string()), "n": pa.array(count, pa.int64())})
    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK, part_bytes: int = PART,
                     room: int = ROOM) -> DataFrame:
    """(lang, size, phrase, n): exact counts of all phrases of 1 to 4 words with at least ``least``
    occurrences in a language, and with size 0 the number of its words. A written table."""
    spark = docs.sparkSession
    scratch: list[str] = []
    t = written(blocks(docs, block_bytes), "phrase-blocks", scratch)
    total = t.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    bits = min(32, max(0, (parts - 1).bit_length()))

    def ask(batches):
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1)):
                names, counts = Phrases(body.as_buffer()).names(bits)
                part = (names >> U(32)).astype(np.int64)
                edge = np.searchsorted(part, np.arange((1 << bits) + 1))
                some = np.flatnonzero(np.diff(edge))
                rows = []
                for q in some.tolist():
                    keys, n = names[edge[q]:edge[q + 1]].astype(np.uint32), counts[edge[q]:edge[q + 1]]
                    rows.append((q, len(keys), int(n.sum()), press(np.diff(keys, prepend=np.uint32(0))), press(n)))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(rows), pa.int64()), *(pa.array(c, x) for c, x in zip(
                        cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())))],
                    names=["block", "part", "n", "mass", "keys", "counts"])
                give_back()
    asked = t.select("block", "body").mapInArrow(ask, "block long, part long, n long, mass long, keys binary, counts binary")
    told = asked.groupBy("part").applyInArrow(_survivors(least, room), "block long, part long, bits binary")
    told = written(told, "phrase-survivors", scratch)
    counted = t.select("block", "body").groupBy("block").cogroup(told.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(_exact(bits), COUNTED)
    found = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))
    found = written(found, "frequent-phrases")
    discard(spark, scratch)
    return found


def _words(a, b):
    return F.array_join(F.slice("words", a, b), " ")


def _scored(found: DataFrame, absorbed: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the collocations among ``found`` (lang, size, phrase, n)."""
    parts = found.where("size > 0").select("lang", "phrase", "n")
    c = found.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ").alias("words"))
    cut = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("first"),
        _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cut = (cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
           .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]))
    # decimals: the product can pass 64 bits
    score = F.expr("cast(cast(a AS decimal(20,0)) * cast(2000000 AS decimal(8,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0))) AS bigint)")
    worst = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.score")
    inner = c.where("size > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    longer = inner.select("lang", _words(F.col("i"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return worst.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(absorbed)} * a").drop("longer")


def _with_words(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.where("size = 0").select("lang", "n"), "lang")


def scored(found: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the collocations among ``found`` (lang, size, phrase, n)."""
    return _with_words(_scored(found, absorbed), found).select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED, **sizes) -> DataFrame:
    """The ``top`` collocations of each language of ``docs`` (text, lang), best first."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = frequent_phrases(docs, least, **sizes)
    # rows are dealt by (lang, phrase) here: each task keeps its best of a language, and only those meet
    ranked = _scored(found, absorbed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return _with_words(ranked, found).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of every language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
