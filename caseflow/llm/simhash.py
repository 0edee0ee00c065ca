"""SimHash near duplicates by tiled exact comparison.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 values of the
text's word shingles, repeats included. Two fingerprints link when they differ in at most
``radius`` bits, and documents are grouped by what links can reach.

Equal fingerprints are one class first. Classes are compared in tiles: a tile against a tile is one
exclusive-or of all their fingerprints and one bit count. The number of differing bits is at least
the difference of the two bit counts, so members are ordered by bit count, and a tile pair whose
counts lie farther apart than the radius is skipped. What one machine could do over one list of
tiles is dealt out like this:

* the 64 bits are cut into ``radius + 1`` blocks or a few more; two fingerprints within the radius
  have the same bits in all but ``radius`` of them. Each fingerprint goes to one group for each such
  choice of blocks, so every pair that links is in one group at least. More blocks make smaller
  groups and more of them; their number follows the number of classes.
* groups of up to ``LARGE`` members are packed into tasks, which cut them into tiles.
* a larger group is one of near copies. Its most frequent fingerprint leads: members within the
  radius of it link with it, which is one row each, and pairs of them need no comparison any more.
  All members are cut into tiles by that, by bit count and by hash; tile pairs are rows of a join,
  and are skipped where both are near the leader or where the bit counts are too far apart.

A tile pair sends back only as many links as connect what it found linked (a forest), never all
pairs. Nothing is capped: a pair is left out only where it cannot link or is connected already.

Defined cases: a null, empty or blank text has the fingerprint zero, which links like any other; a
text of fewer words than a shingle is one shingle. Rows that repeat a doc_id get their own
fingerprint each. A null doc_id is never the smallest; a component of null ids only has a null id.
An empty table gives no rows. Extra columns are ignored. A text of any length is read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.blocks import discard, give_back, written
from caseflow.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE, LARGE, TASK = 512, 1 << 14, 1 << 18
SPREAD = 1 << 9  # members of a group, about, that the number of blocks aims at


def fingerprint(text: bytes | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text: bytes lower-cased for A-Z, words between ASCII blanks."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    if len(words) < n:
        start, end = [0], [len(joined)]
    else:
        start, end = (end - size)[:len(words) - n + 1].tolist(), end[n - 1:].tolist()
    total, view, digest = np.zeros(64, np.int64), memoryview(joined), xxhash.xxh64_intdigest
    for at in range(0, len(start), 1 << 14):
        h = np.array([digest(view[s:e], seed) for s, e in zip(start[at:at + (1 << 14)], end[at:at + (1 << 14)])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp (the fingerprint as a signed number)."""
    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), n, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks (signed) of every choice of all but ``radius`` of the blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << cut[i + 1]) - (1 << cut[i])) for i in range(blocks)]
    found = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks that leave about SPREAD of n evenly spread fingerprints in a group."""
    k = radius + 1
    while k < 2 * radius + 4 and n >> (64 * (k - radius) // k) > SPREAD:
        k += 1
    return k


class Forest:
    """Who is connected with whom among numbered members; links are added many at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def links(self):
        """(member, its root) of every member that is not its own root."""
        some = np.flatnonzero(self.up != np.arange(len(self.up)))
        return some, self.up[some]


def tile_links(x: np.ndarray, y: np.ndarray, radius: int):
    """Places in two tiles (uint64) whose fingerprints differ in at most ``radius`` bits."""
    return np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)


def group_links(fp: np.ndarray, radius: int, tile: int = TILE):
    """Links that connect the members of one group, tile against tile: (member, its root, how many
    tile pairs were compared)."""
    ones = np.bitwise_count(fp)
    order = np.argsort(ones, kind="stable")
    fp, ones, forest = fp[order], ones[order].astype(np.int64), Forest(len(fp))
    compared = 0
    for a in range(0, len(fp), tile):
        last = ones[min(a + tile, len(fp)) - 1]
        for b in range(a, len(fp), tile):
            if ones[b] - last > radius:  # ordered by bit count: all later tiles are farther still
                break
            i, j = tile_links(fp[a:a + tile], fp[b:b + tile], radius)
            forest.add(a + i, b + j)
            compared += 1
    i, j = forest.links()
    return order[i], order[j], compared


LINKS = "a long, b long"


def _sent(fp: np.ndarray, forest: Forest) -> pa.Table:
    a, b = forest.links()
    return pa.table({"a": pa.array(fp[a].view(np.int64)), "b": pa.array(fp[b].view(np.int64))})


def _small(radius: int):
    def run(table: pa.Table) -> pa.Table:
        group = np.unique(table.column("group").to_numpy(), return_inverse=True)[1]
        fp, place = np.unique(table.column("fp").to_numpy().view(np.uint64), return_inverse=True)
        order = np.argsort(group, kind="stable")
        edge = np.append(0, np.cumsum(np.bincount(group)))
        forest, found = Forest(len(fp)), [np.zeros((2, 0), np.int64)]
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            some = place[order[s:e]]
            a, b, _ = group_links(fp[some], radius)
            if len(a):
                found.append(np.stack([some[a], some[b]]))
        forest.add(*np.concatenate(found, 1))
        out = _sent(fp, forest)
        give_back()
        return out
    return run


def _tiles(radius: int):
    def run(batches):
        for b in batches:
            sent = []
            for left, right in zip(b.column(0), b.column(1)):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (left, right))
                fp, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                forest = Forest(len(fp))
                for at in range(0, len(x), TILE):
                    i, j = tile_links(x[at:at + TILE], y, radius)
                    forest.add(place[at + i], place[len(x) + j])
                sent.append(_sent(fp, forest))
            if sent:
                yield from pa.concat_tables(sent).to_batches()
    return run


def _large_links(members: DataFrame, radius: int, scratch: list[str], tile: int) -> list[DataFrame]:
    """Links of the groups that no single task takes: members (group, fp, leader)."""
    m = members.select("group", "fp", "leader", (F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= radius).alias("near"),
                       F.bit_count("fp").alias("ones"))
    star = m.where("near AND fp <> leader").select(F.col("leader").alias("a"), F.col("fp").alias("b"))
    size = m.groupBy("group", "near", "ones").agg(F.count(F.lit(1)).alias("n"))
    dealt = m.join(size, ["group", "near", "ones"]).withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)))
    tiles = dealt.groupBy("group", "near", "ones", "part").agg(F.collect_list("fp").alias("fps"))
    tiles = written(tiles.withColumn("tile", F.monotonically_increasing_id()), "simhash-tiles", scratch)
    left = tiles.select("group", F.col("tile").alias("x"), F.col("near").alias("near_x"), F.col("ones").alias("ones_x"))
    right = tiles.select("group", F.col("tile").alias("y"), F.col("near").alias("near_y"), F.col("ones").alias("ones_y"))
    pairs = left.join(right, "group").where(
        (F.col("x") <= F.col("y")) & ~(F.col("near_x") & F.col("near_y")) & (F.abs(F.col("ones_x") - F.col("ones_y")) <= radius))
    pairs = written(pairs.select("x", "y"), "simhash-tile-pairs", scratch)
    both = (pairs.join(tiles.select(F.col("tile").alias("x"), F.col("fps").alias("fps_x")), "x")
            .join(tiles.select(F.col("tile").alias("y"), F.col("fps").alias("fps_y")), "y"))
    return [star, both.select("fps_x", "fps_y").mapInArrow(_tiles(radius), LINKS)]


def linked(classes: DataFrame, radius: int = RADIUS, blocks: int | None = None, large: int = LARGE, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect every two of the distinct fingerprints ``classes`` (fp, n: how many
    documents have it) that differ in at most ``radius`` bits. The result is a written table."""
    scratch: list[str] = []
    k = blocks or blocks_for(classes.count(), radius)
    chosen = masks(radius, k)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(chosen)])
    members = classes.select("fp", "n", F.explode(keys).alias("k")).select(F.xxhash64("k.choice", "k.bits").alias("group"), "fp", "n")
    # two groups under one name cost comparisons, never a link
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.max_by("fp", F.struct("n", "fp")).alias("leader")).where("size > 1")
    members = written(members.drop("n").join(sizes, "group"), "simhash-members", scratch)
    few = members.where(F.col("size") <= large)
    tasks = max(1, -(-few.count() // TASK))
    small = few.select("group", "fp", F.pmod(F.xxhash64("group"), F.lit(tasks)).alias("task")).groupBy("task").applyInArrow(_small(radius), LINKS)
    parts = [small]
    many = members.where(F.col("size") > large)
    if not many.isEmpty():
        parts += _large_links(many.select("group", "fp", "leader"), radius, scratch, tile)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = written(out, "simhash-links")
    discard(classes.sparkSession, scratch)
    return out


def near_groups(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, **tiling) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, component_id (the smallest doc_id that
    links of at most ``radius`` differing bits reach)."""
    prints = written(fingerprints(docs, n, seed), "fingerprints")
    scratch: list[str] = []
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("n")), "fingerprint-classes", scratch)
    links = linked(classes.select("fp", "n"), radius, **tiling)
    named = components(links, scratch)
    # a fingerprint without links is its own component
    roots = classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "lowest", F.coalesce("component", "fp").alias("component"))
    lowest = roots.groupBy("component").agg(F.min("lowest").alias("component_id"))
    told = written(roots.join(lowest, "component").select("fp", "component_id"), "fingerprint-components")
    discard(docs.sparkSession, scratch)
    # the rows of a frequent fingerprint are split over tasks by the skew handling of this join
    return prints.join(told, "fp").select("doc_id", "fp", "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
