"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its word shingles. Two sets link when their Jaccard similarity is
at least num / den. Linked sets are of similar size and differ in few shingles, so:

* sizes are cut into bands in which the largest size is at most den / num times the
  smallest; linked sets lie in one band or in neighbouring ones;
* in a band, linked sets differ in at most k shingles. The shingle domain is hashed into
  k + 1 + z partitions, so at least z + 1 of them hold the same shingles in both sets. The
  subset of a partition is one signature; each set sends those of its own band and, where
  a smaller partner is possible, of the band below. A set with at most z empty partitions
  need not send their signatures, because a non-empty one is shared as well.

Sets that share a signature are candidates, and links are decided by exact comparison.
Equal sets first collapse to one node. The pairs of a signature are not all compared, and
yet no link between components is missed:

* the node that shares most signatures leads; every other node of the signature is compared
  with it, which gives their distance (the number of shingles in one set only);
* a pair of nodes that link lies, by the triangle inequality, either both near the leader or
  both far from it. Far nodes get a second leader. Those far from both mostly share a passage
  and nothing else; they meet at the prefixes of their sets, in one order of all their shingles
  (rare ones first): sets that link hold a first common shingle so early in both that the
  rest can still reach the overlap. Passages that many hold come last and are not reached;
* near the leader O, x and y with distances a and b link only if their differences to O
  have at least (a + b - t) / 2 shingles in common, t being the distance at which sets of
  their sizes still link. Unless both link with O this is positive, so the pair meets at a
  shingle of the prefixes of both differences, in one order of all shingles (those that few
  differences to O hold first). Only such pairs, still in different components, are compared.

So a family of near copies costs comparisons in proportion to its members, not its pairs, and
so do documents with a common passage. Signatures, sets and pairs are worked on in turns (``PASSES``,
``ROUND``), and the shuffle files of a turn go before the next.

Defined cases: documents without words, or null, have the empty set, link with nothing and
are their own component; fewer words than a shingle make one shingle; rows are told apart by
doc_id and text, so rows that repeat a doc_id each get the component of their own text, and
rows that repeat both share it; a null doc_id sorts first. Extra columns are ignored by
``link`` and kept by ``keep_one``.
"""

from __future__ import annotations

from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import hashing as H
from caseflow.llm.blocks import NULL_KEY, bucketed, discard, release, written
from caseflow.llm.components import components
from caseflow.llm.text import fresh

SLICE = 1 << 21  # bytes of text worked on at once
PASSES = 4  # turns in which signatures meet and sets are made
ROUND = 1  # pairs compared in one round, for each set there is
PIECE = 1024  # comparisons with one leader that meet in one task


class Bands:
    """Size bands and partition numbers for sets of up to ``largest`` shingles."""

    def __init__(self, num: int, den: int, largest: int):
        low, top, k, z = [], [], [], []
        size = 1
        while size <= max(largest, 1):
            u = max(size, size * den // num)
            diff = u * (den - num) // num
            low.append(size), top.append(u), k.append(diff)
            z.append(2 + int(3 * (diff + 1) * exp(-size / (diff + 1))))
            size = u + 1
        self.low, self.top, self.k, self.z = (np.array(x, np.int64) for x in (low, top, k, z))
        self.parts = self.k + 1 + self.z
        self.num, self.den = num, den

    def of(self, size):
        return np.searchsorted(self.low, size, "right") - 1


def shingle_sets(buf, off, n: int):
    """Distinct shingle hashes per row: (row numbers, hashes), in order of both."""
    buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    start, end, word_off = H.words(buf, off)
    h = H.word_hash(buf, start, end, 31)
    at = H.inside_row(word_off, len(h), n)
    row = H.row_of(word_off, len(h))
    count = np.diff(word_off)
    rows, grams = [row[at]], [H.gram_hash(h, n, 32)[at] if len(at) else np.zeros(0, np.uint64)]
    short = np.flatnonzero((count > 0) & (count < n))
    rows.append(short)
    grams.append(H.span_hash(h, word_off[short], word_off[short + 1], 33) if len(short) else np.zeros(0, np.uint64))
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))[:len(row)]
    return row[new], gram[new]


def signatures(row, gram, size, num: int, den: int):
    """PartEnum signatures of the sets: (row numbers, signatures)."""
    bands = Bands(num, den, int(size.max(initial=0)) + 1)
    own = bands.of(np.maximum(size, 1))
    out_row, out_sig = [], []
    for below in (0, 1):
        band = np.maximum(own - below, 0)
        # the band below matters if it holds a size that can still link; with k = 0 only equal sets link
        use = (size > 0) & (bands.k[band] > 0) & (own >= below)
        if below:
            use &= bands.top[band] * den >= size * num
        if not use.any():
            continue
        parts = np.where(use, bands.parts[band], 0)
        base = np.cumsum(parts) - parts
        some = use[row]
        r, g = row[some], gram[some]
        b = band[r]
        j = (H.mix(g ^ H.mix(b.astype(np.uint64) + np.uint64(77))) % parts[r].astype(np.uint64)).astype(np.int64)
        total = np.zeros(parts.sum(), np.uint64)
        filled = np.zeros(parts.sum(), bool)
        np.add.at(total, base[r] + j, H.mix(g + np.uint64(0x9E3779B97F4A7C15)))
        filled[base[r] + j] = True
        owner = np.repeat(np.arange(len(size)), parts)
        place = np.arange(len(owner)) - base[owner]
        sig = H.mix(H.mix(total + place.astype(np.uint64)) + band[owner].astype(np.uint64))
        empties = np.bincount(owner, ~filled, len(size))
        send = filled | (empties > bands.z[band])[owner]
        out_row.append(owner[send])
        out_sig.append(sig[send])
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_sig)


def _texts(batch):
    """Slices of a batch (key, text as large binary): (from, to, buf, off)."""
    text = batch.column(1).fill_null(b"").cast(pa.large_binary())
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
        yield a, b, buf[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def _lists(row, values, n):
    off = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))


def profiles(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """key and hash (of the row), n_shingles, c1 and c2 (128-bit name of the set), sigs0, sigs1 ...: the
    signatures of each pass."""
    passes = PASSES
    names = [f"sigs{i}" for i in range(passes)]

    def run(batches):
        for batch in batches:
            for a, b, buf, off in _texts(batch):
                row, gram = shingle_sets(buf, off, n)
                size = np.bincount(row, minlength=b - a)
                c = [np.zeros(b - a, np.uint64) for _ in range(2)]
                np.add.at(c[0], row, H.mix(gram))
                np.add.at(c[1], row, H.mix(gram ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                srow, sig = signatures(row, gram, size, num, den)
                order = np.lexsort((srow, sig % np.uint64(passes)))
                srow, sig = srow[order], sig[order]
                ends = np.searchsorted(sig % np.uint64(passes), np.arange(passes + 1, dtype=np.uint64))
                sigs = [_lists(srow[i:j], sig[i:j], b - a) for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size), *(pa.array(x.view(np.int64)) for x in c), *sigs],
                    names=["key", "hash", "n_shingles", "c1", "c2", *names])
    return rows.mapInArrow(run, "key long, hash long, n_shingles long, c1 long, c2 long, " + ", ".join(f"{x} array<long>" for x in names))


def sets_of(rows: DataFrame, n: int) -> DataFrame:
    """key, grams (sorted distinct shingle hashes)."""
    def run(batches):
        for batch in batches:
            for a, b, buf, off in _texts(batch):
                row, gram = shingle_sets(buf, off, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(row, gram, b - a)],
                                                 names=["key", "grams"])
    return rows.mapInArrow(run, "key long, grams array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, scratch: list[str]) -> DataFrame:
    """The distinct pairs (a, b) whose sets reach the similarity."""
    return compared(pairs.select(F.col("a").alias("x"), F.col("b").alias("leader")), sets, num, den, scratch,
                    lambda c: c.where("linked").select(*_ordered("x", "leader")))


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int, scratch: list[str], keep=lambda c: c) -> DataFrame:
    """``keep`` of the distinct pairs (x, leader) compared, in written tables: the size of x, their
    distance, whether they link, whether x is near and whether it is far (it can be both), and for
    a near x the difference and the length of its prefix that a link between x and others must meet.

    A pair carries the set of x to that of the leader, so shuffles would grow with the pairs. They are
    dealt over rounds of ``ROUND`` pairs for each set there is, and each round's shuffle files go
    before the next. The comparisons with one leader are dealt over pieces of some ``PIECE``, each
    with its own copy of the leader's set. ``sets`` is bucketed by key: it meets x without a shuffle."""
    spark = pairs.sparkSession
    pairs = written(pairs, "pairs", scratch)
    rounds = max(1, ceil(pairs.count() / (ROUND * max(1, sets.count()))))
    pieces = written(pairs.groupBy("leader").agg(F.floor(F.count(F.lit(1)) / PIECE + 1).alias("pieces")), "pieces", scratch)
    dealt = pairs.join(pieces, "leader").select("x", "leader", F.pmod(F.xxhash64("x"), F.col("pieces")).alias("piece"))
    if rounds > 1:
        dealt = written(dealt, "dealt-pairs", scratch)
    copies = pieces.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    turn = F.pmod(F.xxhash64("leader", "piece"), F.lit(rounds))

    def one(p, q):
        extra, missing = np.setdiff1d(p, q, assume_unique=True), np.setdiff1d(q, p, assume_unique=True)
        dist, same = len(extra) + len(missing), len(p) - len(extra)
        linked = den * same >= num * (len(p) + len(missing))
        reach = len(p) * (den - num) / num  # sets that link with x are no farther from it
        near = 10 * dist <= 8 * len(q)
        if linked:  # it must overlap with differences that are too long to link
            least = (dist - max((len(p) - len(q)) * (den - num) / (den + num), 0)) / 2
        else:
            least = (dist + 1 - reach) / 2
        prefix = dist - max(1, ceil(least - 1e-9)) + 1
        return (len(p), dist, linked, near, 10 * dist > 8 * len(q) - 10 * reach, prefix,
                np.concatenate([extra, missing]) if near and prefix > 0 else None)

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            rows = [one(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 *(pa.array([bool(v) for v in c], pa.bool_()) for c in cols[2:5]),
                 pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.list_(pa.int64()))],
                names=["x", "leader", "size", "dist", "linked", "near", "far", "prefix", "diff"])
    paths: list[str] = []
    for i in range(rounds):
        leaders = copies.where(turn == i).join(sets.select(F.col("key").alias("leader"), F.col("grams").alias("gl")), "leader")
        both = (dealt.where(turn == i).join(sets.select(F.col("key").alias("x"), F.col("grams").alias("gx")), "x")
                .join(leaders, ["leader", "piece"]).select("x", "leader", "gx", "gl"))
        out = written(keep(both.mapInArrow(run, "x long, leader long, size long, dist long, linked boolean, near boolean, "
                                           "far boolean, prefix long, diff array<long>")), "compared", paths)
        if rounds > 1:
            release(spark)
    scratch += paths
    return spark.read.schema(out.schema).parquet(*paths)


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


class Components:
    """The components that the links found so far make: (node, component), null until the first."""

    def __init__(self):
        self.label, self.scratch = None, []

    def add(self, found: DataFrame) -> None:
        """Join the components of linked nodes. Only links between different components are kept, so
        each call works on a graph of components, not of nodes."""
        ends = self.of(self.of(found, "a", "ca"), "b", "cb").where("ca <> cb")
        merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), self.scratch)
        if self.label is not None:
            merged = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
            nodes = self.label.join(merged, "component", "full")
            merged = nodes.select(F.coalesce("node", "component").alias("node"), F.coalesce("root", "component").alias("component"))
        self.label = written(merged, "components", self.scratch)
        release(found.sparkSession)

    def of(self, rows: DataFrame, node: str, out: str) -> DataFrame:
        """``rows`` with the component of ``node`` as ``out``."""
        if self.label is None:
            return rows.withColumn(out, F.col(node))
        names = self.label.select(F.col("node").alias(node), F.col("component").alias(out))
        return rows.join(names, node, "left").withColumn(out, F.coalesce(out, node))


def _led(members: DataFrame, found: Components, sets: DataFrame, num: int, den: int):
    """Compare the members (sig, node, fame) of every signature in several components with its
    most shared node: (comparisons, signatures with their leaders)."""
    m = found.of(members, "node", "comp")
    lead = (m.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                 F.max(F.struct("fame", -F.col("node"))).alias("lead"))
            .where("lo < hi").select("sig", (-F.col("lead.col2")).alias("leader")))
    lead = written(lead, "leaders", found.scratch)
    pairs = members.join(lead, "sig").where("node <> leader").select(F.col("node").alias("x"), "leader").distinct()
    done = compared(pairs, sets, num, den, found.scratch)
    found.add(written(done.where("linked").select(*_ordered("x", "leader")).distinct(), "links", found.scratch))
    return done, lead


def _far(members: DataFrame, done: DataFrame, lead: DataFrame, found: Components) -> DataFrame:
    """The members (sig, node, fame) that are far from their signature's leader."""
    far = done.where("far").select(F.col("x").alias("node"), "leader")
    return written(members.join(lead, "sig").join(far, ["node", "leader"], "left_semi").select("sig", "node", "fame"), "far", found.scratch)


def _meet(near: DataFrame, found: Components, sets: DataFrame, num: int, den: int) -> None:
    """Find the links between nodes near a common leader, through the prefixes of their differences."""
    n = found.of(found.of(near, "x", "comp"), "leader", "leader_comp")
    several = (n.groupBy("leader").agg(F.min(F.least("comp", "leader_comp")).alias("lo"),
                                       F.max(F.greatest("comp", "leader_comp")).alias("hi")).where("lo < hi").select("leader"))
    rows = (n.join(several, "leader", "left_semi").where("prefix > 0")
            .select("leader", "x", "size", "dist", "linked", "prefix", "comp", "diff"))
    rows = written(rows, "near-rows", found.scratch).withColumn("e", F.explode("diff")).drop("diff")
    rows = _prefixes(rows, ["leader"], "dist", found.scratch)
    slack = f"floor((size + size2) * {den - num} / {den + num})"
    need = f"greatest(1, ceil((dist + dist2 - {slack}) / 2))"
    can = F.expr(f"place <= dist - {need} + 1 AND place2 <= dist2 - {need} + 1 AND NOT (linked AND linked2)")
    _pairs(rows, ["leader", "e"], "dist", can, found, sets, num, den)


def _prefixes(rows: DataFrame, by: list[str], total: str, scratch: list[str]) -> DataFrame:
    """The shingles ``e`` of x among the first ``prefix`` of its ``total`` ones, with their place. In each
    group ``by`` they are in one order: those that meet no other component (left out), then rare ones first."""
    held = (rows.groupBy(*by, "e").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
            .where("lo < hi").select(*by, "e", "n"))
    held = written(held, "met-shingles", scratch)
    release(rows.sparkSession)
    x = [c for c in rows.columns if c not in ("e", "comp")]
    met = rows.join(held, [*by, "e"]).groupBy(*x).agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("met"))
    met = met.select(*x, (F.col(total) - F.size("met")).alias("before"), F.posexplode("met").alias("at", "m"))
    met = met.withColumn("place", F.col("before") + F.col("at") + 1).where("place <= prefix")
    met = written(met.select(*[c for c in x if c != "prefix"], "place", "m.e"), "prefixes", scratch)
    release(rows.sparkSession)
    return met


def _pairs(rows: DataFrame, by: list[str], nearest: str, can, found: Components, sets: DataFrame, num: int, den: int) -> None:
    """Compare rows (x and others) that agree in ``by`` where ``can`` holds for a row and another (its
    columns end in 2) of other components: first all with the ``nearest``, then those still apart."""
    for all_pairs in (False, True):
        r = found.of(rows, "x", "comp")
        apart = (r.groupBy(*by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(nearest, "x")).alias("first"))
                 .where("lo < hi").select(*by, F.col("first.x").alias("first")))
        r = written(r.join(written(apart, "apart", found.scratch), by), "meeting", found.scratch)
        other = r.select(*by, *[F.col(c).alias(c + "2") for c in r.columns if c not in [*by, "first"]])
        if not all_pairs:
            other = other.join(r.select(*by, F.col("first").alias("x2")).distinct(), [*by, "x2"], "left_semi")
        else:
            can = can & (F.col("x") < F.col("x2"))
        pairs = written(r.join(other, by).where(can).where("comp <> comp2").select(*_ordered("x", "x2")).distinct(), "pairs", found.scratch)
        if not pairs.isEmpty():
            found.add(verified(pairs, sets, num, den, found.scratch))


def _rare(far: DataFrame, found: Components, sets: DataFrame, num: int, den: int) -> None:
    """Find the links between nodes (sig, node) far from the leaders, through the prefixes of their sets."""
    far = found.of(far, "node", "comp")
    several = far.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    nodes = written(far.join(several, "sig").select(F.col("node").alias("key"), "comp").distinct(), "far-nodes", found.scratch)
    size = F.size("grams").cast("long")
    rows = sets.join(nodes, "key").select(F.col("key").alias("x"), "comp", size.alias("size"), F.explode("grams").alias("e"))
    rows = rows.withColumn("prefix", F.expr(f"size - (size * {num} + {den - 1}) div {den} + 1"))
    rows = _prefixes(rows, [], "size", found.scratch)
    # the shingles from the first common one on must reach the overlap of sets of these sizes
    can = F.expr(f"{num + den} * (1 + least(size - place, size2 - place2)) >= {num} * (size + size2)")
    _pairs(rows, ["e"], "place", can, found, sets, num, den)


def _row_key(docs: DataFrame):
    """What tells rows apart: doc_id (NULL_KEY for null) and a hash of the text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY)), F.xxhash64(docs["text"].cast("binary"))


def link(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links)."""
    null = F.lit(NULL_KEY)
    return _linked(docs, n, num, den).select(F.nullif("key", null).alias("doc_id"), "n_shingles",
                                             F.nullif("lowest.key", null).alias("component_id"))


def _linked(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One row per row of ``docs``: key, hash, n_shingles, lowest (key and hash of the first row of
    its component)."""
    spark = docs.sparkSession
    key, name = _row_key(docs)
    rows = docs.select(key.alias("key"), docs["text"].cast("binary").alias("text"), name.alias("hash"))
    scratch: list[str] = []
    first, second, third = [], [], []
    signed = written(profiles(rows, n, num, den), "shingle-profiles", first)
    p = written(signed.select("key", "hash", "n_shingles", "c1", "c2"), "shingle-sizes", scratch)
    full = p.where("n_shingles > 0")
    # a class of equal sets is one node, numbered as it is written; its first row stands for it
    classes = full.groupBy("c1", "c2", "n_shingles").agg(F.min(F.struct("key", "hash")).alias("row"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-classes", scratch)
    for i in range(PASSES):
        entries = signed.select(F.explode(f"sigs{i}").alias("sig"), "c1")
        shared = entries.groupBy("sig").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo < hi").select("sig")
        shared = written(shared, "shared-signatures", third)
        release(spark)
        met = written(entries.join(shared, "sig").distinct(), "signature-sets", second)
        release(spark)
    discard(spark, first)
    met = spark.read.schema(met.schema).parquet(*second)
    members = written(met.join(classes.select("c1", "node"), "c1").select("sig", "node"), "signature-members", third)
    discard(spark, second)
    fame = members.join(members.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sig").groupBy("node").agg(F.sum("n").alias("fame"))
    members = written(members.join(fame, "node").select("sig", "node", "fame"), "members-fame", scratch)
    discard(spark, third)
    involved = written(members.select("node").distinct().join(classes.select("node", "row.key", "row.hash"), "node"), "involved", scratch)
    table = None
    for i in range(PASSES):
        turn = F.pmod(F.col("hash"), F.lit(PASSES)) == i
        texts = rows.where(turn).join(involved.where(turn), ["key", "hash"]).select(F.col("node").alias("key"), "text")
        # rows that repeat doc_id and text are one set
        table, sets = bucketed(sets_of(texts, n).dropDuplicates(["key"]), "key", "sets", scratch, to=table)
        release(spark)

    found = Components()
    done, lead = _led(members, found, sets, num, den)
    far = _far(members, done, lead, found)
    done2, lead2 = _led(far, found, sets, num, den)
    _rare(_far(far, done2, lead2, found), found, sets, num, den)
    near = done.where("near").unionByName(done2.where("near")).dropDuplicates(["x", "leader"])
    _meet(near, found, sets, num, den)

    named = written(found.of(classes, "node", "component"), "class-components", scratch)
    lowest = written(named.groupBy("component").agg(F.min("row").alias("lowest")), "component-rows", scratch)
    named = written(named.join(lowest, "component").select("c1", "c2", "n_shingles", "lowest"), "class-rows", scratch)
    # the labels are written: the rows of a large class are split by the join
    out = full.join(named, ["c1", "c2", "n_shingles"]).select("key", "hash", "n_shingles", "lowest")
    empty = p.where("n_shingles = 0").select("key", "hash", "n_shingles", F.struct("key", "hash").alias("lowest"))
    out = written(out.unionByName(empty), "jaccard-components")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    discard(spark, scratch + found.scratch)
    return out


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document (doc_id and text) of each component: the one of the smallest doc_id."""
    gone, gone_hash = fresh(docs, "_gone"), fresh(docs, "_gone_hash")
    found = _linked(docs, n, num, den)
    drop = (found.where("key <> lowest.key OR hash <> lowest.hash")
            .select(F.col("key").alias(gone), F.col("hash").alias(gone_hash)).distinct())
    key, name = _row_key(docs)
    return docs.join(drop, (key == F.col(gone)) & (name == F.col(gone_hash)), "left_anti")


def op9_partenum(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have similarity 0.9 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link(docs, n=3, num=90)
