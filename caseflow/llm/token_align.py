"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text is encoded twice: a blank and the text by a byte-level BPE table (A), and the text by a
sentencepiece model (B), which puts the blank itself. Both token sequences cut the same bytes, so
their ends are two ascending arrays, and aligning them is a merge. Merge-path partitioning makes
the merge independent of how long single texts are: the texts of a slice lie one behind another,
a binary search on every ``PIECE``-th diagonal of the merge finds how many ends of A and of B come
before it, and each piece between two diagonals is merged by itself, all of equal work. A piece
emits its overlaps (token of A, token of B, end of the shared bytes) and which of them end in a
token end of both; the last overlap of a piece is stitched to the first end of the next, since
equal ends can lie on both sides of a diagonal. Where ends meet, a group of tokens is closed, and
the two tokens that end there are linked.

How often an id pair is linked in the whole corpus needs a second step: slices are written with
their distinct pairs and each link as the place of its pair; pairs are counted by an ordinary
aggregate, the highest count of each B id by another, and every slice gets the counts of its own
pairs back by a join. Texts are encoded once. A pair that all texts hold is one row per slice.

Defined cases: a text that is null, empty, not valid UTF-8, or whose joined bytes of A or of B are
not the blank and the text has no tokens: zeros and empty strings. Rows that repeat a doc_id, and
null ids, are answered each by itself, but all count. Ties for the highest count are all best. An
empty table gives no rows. Extra columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.blocks import give_back, pack, unpack, written

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
SLICE = 4 << 20
PIECE = 1 << 15
# how the byte-level table cuts a text before it merges (fixed value, as published with the table)
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, the other way round:
    printable Latin-1 characters stand for themselves, the rest for 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def tokenizer_a(path: str):
    """(encode, bytes of every id) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["id"] for t in spec.get("added_tokens") or []}
    vocab, back = spec["model"]["vocab"], byte_alphabet()
    names = [b""] * (max([*vocab.values(), *special]) + 1)
    for t, i in vocab.items():
        if i not in special:
            names[i] = bytes(back[c] for c in t)
    plain = _tokenizers(path)
    pre = spec.get("pre_tokenizer") or {}
    if not (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and _ranked(spec["model"], names, special)):
        return plain, names
    import tiktoken
    fast = tiktoken.Encoding("a", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks={n: i for i, n in enumerate(names) if i not in special})

    def encode(text):
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # the pattern's engine gives up on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return plain(text)
    return encode, names


def _tokenizers(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return lambda text: t.encode(text, add_special_tokens=False).ids


def _ranked(model: dict, names: list[bytes], special: set[int]) -> bool:
    """Whether ids are the order of the merges, behind the 256 bytes: merging by id is then the same."""
    if any(len(n) != 1 for n in names[:256]) or special & set(range(256)):
        return False
    back = byte_alphabet()
    for i, m in enumerate(model["merges"]):
        left, right = m.split(" ") if isinstance(m, str) else m
        if names[256 + i] != bytes(back[c] for c in left + right):
            return False
    return 256 + len(model["merges"]) + len(special) == len(names)


@lru_cache(2)
def tokenizer_b(path: str):
    """(encode, bytes of every id) of a sentencepiece file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def name(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
    return lambda text: sp.encode(text), [name(i) for i in range(sp.get_piece_size())]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int):
    """How many of ``a`` and of ``b`` come before every ``piece``-th place of their merge, by binary
    search on the diagonals; of equal values that of ``a`` comes first."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        more = np.zeros(len(d), bool)
        more[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low = np.where(open_ & more, mid + 1, low)
        high = np.where(open_ & ~more, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, j0: int):
    """One piece of the merge, which starts at token i0 of A and j0 of B: its ends in order, the
    tokens of A and B that cover the bytes before each, and where the ends of both meet."""
    at_a = np.arange(len(a)) + np.searchsorted(b, a, "left")
    from_a = np.zeros(len(a) + len(b), bool)
    from_a[at_a] = True
    end = np.empty(len(from_a), np.int64)
    end[from_a], end[~from_a] = a, b
    before = np.cumsum(from_a)
    i, j = i0 + before - from_a, j0 + np.arange(len(end)) - (before - from_a)
    meet = np.zeros(len(end), bool)
    meet[:-1] = from_a[:-1] & ~from_a[1:] & (end[:-1] == end[1:])
    return end, i, j, from_a, meet


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """Overlaps of two tokenizations by their ascending token ends, which share the last one:
    (token of A, token of B, end, whether both tokens end there), in order."""
    ia, jb = diagonals(a, b, piece)
    parts = [merge_piece(a[i0:i1], b[j0:j1], i0, j0)
             for i0, i1, j0, j1 in zip(ia[:-1].tolist(), ia[1:].tolist(), jb[:-1].tolist(), jb[1:].tolist())]
    for left, right in zip(parts, parts[1:]):  # stitch: equal ends on both sides of a diagonal
        if left[3][-1] and not right[3][0] and left[0][-1] == right[0][0]:
            left[4][-1] = True
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(bool)
    end, i, j, _, meet = (np.concatenate(x) for x in zip(*parts))
    some = np.append(True, end[1:] != end[:-1])  # the second of two equal ends covers no bytes
    return i[some], j[some], end[some], meet[some]


class Aligned:
    """Texts of one slice, encoded and aligned: ids of both tokenizers one text behind another,
    token counts by text, and for each group the tokens of A and B up to its end."""

    def __init__(self, texts, a_file: str, b_file: str, piece: int = PIECE):
        (enc_a, bytes_a), (enc_b, bytes_b) = tokenizer_a(a_file), tokenizer_b(b_file)
        size_a, size_b = (np.array([len(x) for x in names], np.int64) for names in (bytes_a, bytes_b))
        none = np.zeros(0, np.int32)
        a, b = [], []
        for raw in texts:
            x = y = none
            if raw:
                want = b" " + raw
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    text = None
                if text is not None:
                    p, q = enc_a(" " + text), enc_b(text)
                    if (b"".join(map(bytes_a.__getitem__, p)) == want and b"".join(map(bytes_b.__getitem__, q)) == want):
                        x, y = np.array(p, np.int32), np.array(q, np.int32)
            a.append(x), b.append(y)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = np.concatenate([none, *a]), np.concatenate([none, *b])
        i, j, _, meet = overlaps(np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b]), piece)
        self.cut_a, self.cut_b = i[meet] + 1, j[meet] + 1
        # a text's last group ends where its bytes end
        self.group_off = np.append(0, np.searchsorted(self.cut_a, np.cumsum(self.n_a), "right"))

    @property
    def n_groups(self) -> np.ndarray:
        return np.diff(self.group_off)


@lru_cache(2)
def _spelled(n: int):
    """Every id as text before each of the marks that can follow it."""
    return [np.array([b"%d%s" % (i, mark) for i in range(n)], object) for mark in (b",", b"|", b";")]


def spellings(x: Aligned) -> list[str]:
    """SHA-256 of every text's groups, written ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    n = len(x.a) + len(x.b)
    comma, bar, semi = _spelled(int(max(x.a.max(initial=0), x.b.max(initial=0))) // 4096 * 4096 + 4096)
    out = np.empty(n, object)
    # a group's tokens of A stand before its tokens of B
    group_a = np.searchsorted(x.cut_a, np.arange(len(x.a)), "right")
    group_b = np.searchsorted(x.cut_b, np.arange(len(x.b)), "right")
    at_a = np.arange(len(x.a)) + np.append(0, x.cut_b)[group_a]
    at_b = np.arange(len(x.b)) + x.cut_a[group_b]
    out[at_a], out[at_b] = comma[x.a], comma[x.b]
    out[at_a[x.cut_a - 1]] = bar[x.a[x.cut_a - 1]]
    out[at_b[x.cut_b - 1]] = semi[x.b[x.cut_b - 1]]
    off = np.append(0, np.cumsum(x.n_a + x.n_b))
    return [hashlib.sha256(b"".join(out[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip(off[:-1].tolist(), off[1:].tolist())]


def _slices(batches):
    """(doc ids, texts as bytes) of at most SLICE bytes, or one text."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
            yield batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at).to_pylist()
            at = to


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def alignments(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the ids of both tokenizers, and for each group how
    many tokens of A and of B there are up to its end."""
    def run(batches):
        for ids, texts in _slices(batches):
            x = Aligned(texts, a_file, b_file)
            off_a, off_b = np.append(0, np.cumsum(x.n_a)), np.append(0, np.cumsum(x.n_b))
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int32)))
                     for o, v in ((off_a, x.a), (off_b, x.b), (x.group_off, x.cut_a - np.repeat(off_a[:-1], x.n_groups)),
                                  (x.group_off, x.cut_b - np.repeat(off_b[:-1], x.n_groups)))]
            yield pa.RecordBatch.from_arrays([ids, *lists], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])
    return _rows(docs).mapInArrow(run, SCHEMA)


def link_counts(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per row of ``docs``: token, group and link counts, how many of its links are the most
    frequent ones of their B id, the sum of its links' counts, and the digest of its groups."""
    def run(batches):
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(_slices(batches)):
            x = Aligned(texts, a_file, b_file)
            pair = x.a[x.cut_a - 1].astype(np.int64) << 32 | x.b[x.cut_b - 1]
            pair, place, n = np.unique(pair, return_inverse=True, return_counts=True)
            body = pack(doc_id=ids, n_a=x.n_a, n_b=x.n_b, n_groups=x.n_groups, groups_sha256=pa.array(spellings(x), pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k], pa.int64()), pa.array([body], pa.binary()), pa.array([pack(place=place.astype(np.uint32))], pa.binary()),
                 pa.array([pair], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))],
                names=["slice", "texts", "links", "pair", "n"])
            give_back()
    t = written(_rows(docs).mapInArrow(run, "slice long, texts binary, links binary, pair array<long>, n array<long>"), "aligned")
    pairs = t.select("slice", F.posexplode(F.arrays_zip("pair", "n")).alias("place", "p")).select("slice", "place", "p.pair", "p.n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = written(counts, "pair-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    ranked = counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    told = pairs.select("slice", "place", "pair").join(ranked, "pair").select(F.col("slice").alias("of"), "place", "count", "best")
    return t.select("slice", "texts", "links").groupBy("slice").cogroup(told.groupBy("of")).applyInArrow(
        _settle, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _settle(left: pa.Table, right: pa.Table) -> pa.Table:
    x = unpack(left.column("texts")[0].as_buffer())
    place = unpack(left.column("links")[0].as_buffer()).column("place").to_numpy()
    order = np.argsort(right.column("place").to_numpy())
    count = right.column("count").to_numpy()[order][place]
    best = right.column("best").to_numpy(zero_copy_only=False)[order][place] if len(order) else np.zeros(0, bool)
    off = np.append(0, np.cumsum(x.column("n_groups").to_numpy()))
    summed = [np.append(0, np.cumsum(v.astype(np.int64)))[off] for v in (best, count)]
    give_back()
    return pa.table({"doc_id": x.column("doc_id"), "n_a": x.column("n_a"), "n_b": x.column("n_b"),
                     "n_groups": x.column("n_groups"), "n_links": x.column("n_groups"),
                     "n_best": np.diff(summed[0]), "count_sum": np.diff(summed[1]), "groups_sha256": x.column("groups_sha256")})


def op13_token_align(spark, sf_dir: str) -> DataFrame:
    """Alignment counts and the digest of the groups of every document."""
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*OUT)
