"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words: a word begins at each run of blanks, and each line break is a word
of its own; the first word of a text gets a leading blank. No piece crosses such a cut (where
a table has pieces that would, it is not made), so the best paths of the words make up the best
path of the text. The distinct words of the corpus are dealt to key partitions by hash, by an
ordinary shuffle, and a partition works out their segmentations as a join and a fold over tables:

1. the starts of all substrings are equi-joined to the piece table, one character longer with
   each join, as long as a piece begins so (the table is kept by prefix and character);
2. the matches are the lattice's edges; a character that is no piece gets an edge of its
   UTF-8 byte pieces, at a score below all others;
3. edges are ordered by end, and the best way to each end is an aggregate over the edges that
   come there, of all words at once, end position by end position. On equal scores the longest
   last piece wins.

The edges of ``SLICE`` characters of words are held at a time and never leave their task, so nothing is
sorted through disk. Words of any length (text without blanks, URLs) take this way, in time and memory linear
in their length. The paths go back to the blocks of texts that asked for them, and
each text is the concatenation of its words' ids. Blanks are written as in the piece
table (U+2581); that character itself, where it is in a text, is encoded as bytes, so
that decoding gives back every text exactly.

A model of merge ranks (scores 0, -1, -2, ...) is read by Zipf's law: the score of rank r is
the logarithm of 1 / (r H) with H the harmonic number of the table's size. A table of log
probabilities is used as it is (``ranked=False``). Tokenizers are read, never trained.

Defined cases: null gives null ids and decodes to null; an empty text gives the empty list.
Rows are encoded by text alone; extra columns are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import hashing as H
from caseflow.llm.blocks import TIGHT, Blocks, answer, pack, split_by_part

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
SLICE = 1 << 18  # bytes of words whose edges are held at a time


class Pieces:
    """The piece table: strings, scores and kinds, and the ids of the 256 byte pieces."""

    def __init__(self, path: str = MODEL, ranked: bool = True):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        h = log(n) + 0.5772
        self.text, self.rows, self.byte_ids = [b""] * n, [], [0] * 256
        for i in range(n):
            p, s = m.id_to_piece(i), m.get_score(i)
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.rows.append((p, i, -log(1 - s) - log(h) if ranked else s))
                self.text[i] = p.replace(BLANK, " ").encode()
        self.worst = min((s for *_, s in self.rows), default=0.0) - 10.0
        self.longest = max((len(p) for p, *_ in self.rows), default=1)
        # whether words may begin at blanks and at line breaks: no piece goes on across them
        self.blank_cuts = not any(BLANK in p.lstrip(BLANK) for p, *_ in self.rows)
        self.line_cuts = not any("\n" in p and len(p) > 1 for p, *_ in self.rows)


class Lattice:
    """The piece table by prefix and next character, and the best paths of words over it."""

    def __init__(self, pieces: Pieces):
        node = {"": 0}
        for piece, *_ in pieces.rows:
            for n in range(1, len(piece) + 1):
                node.setdefault(piece[:n], len(node))
        key = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in node if p], np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], order + 1  # a prefix has the number of its place
        self.piece, self.score = np.full(len(node), -1, np.int32), np.zeros(len(node))
        for piece, i, score in pieces.rows:
            self.piece[node[piece]], self.score[node[piece]] = i, score
        self.worst, self.byte_ids = pieces.worst, np.array(pieces.byte_ids, np.int32)

    def paths(self, words: pa.Array):
        """(first, size, ids) of an array of words in bytes: word ``i`` has ``ids[first[i]:first[i] + size[i]]``."""
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(lengths, kind="stable")  # words of about one length go together
        size, pool = np.zeros(len(order), np.int64), [np.zeros(0, np.int32)]
        for some in np.split(order, np.flatnonzero(np.diff(np.cumsum(lengths[order]) // SLICE)) + 1):
            if len(some):
                size[some], ids = self._paths(words.take(pa.array(some)))
                pool.append(ids)
        first = np.zeros(len(order), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return first, size, np.concatenate(pool)

    def _edges(self, m, stop):
        """The edges of the characters ``m``, whose words end at ``stop``: (start, length, piece, score); piece -1
        is a character spelt in bytes. The longest come first."""
        at, node, out, length = np.arange(len(m)), np.zeros(len(m), np.int64), [], 0
        while len(at):
            key = node << 21 | m[at + length]
            i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[i] == key if len(self.key) else np.zeros(len(at), bool)
            length += 1
            if length == 1:
                spelt = np.ones(len(at), bool)
                spelt[hit] = self.piece[self.child[i[hit]]] < 0
                alone = at[spelt]
                out.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), -1, np.int32), np.full(len(alone), self.worst)))
            at, node = at[hit], self.child[i[hit]]
            end = self.piece[node] >= 0
            out.append((at[end], np.full(end.sum(), length), self.piece[node[end]], self.score[node[end]]))
            more = at + length < stop[at]
            at, node = at[more], node[more]
        return [np.concatenate(c) for c in zip(*reversed(out))]

    def _paths(self, words: pa.Array):
        """(size, ids) of the words, in their order."""
        data = b"".join(words.to_pylist())
        buf = np.frombuffer(data, np.uint8)
        char_at = np.flatnonzero(buf & 0xC0 != 0x80)  # bytes where characters begin
        chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        m = np.where(chars == 0x20, ord(BLANK), np.where(chars == ord(BLANK), 0xFFFF, chars))
        stop = np.searchsorted(char_at, np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False)))
        n = np.diff(np.append(0, stop))
        word = np.repeat(np.arange(len(n)), n)  # by character
        start, length, piece, score = self._edges(m, np.repeat(stop, n))
        # places between characters: a word of n has n + 1, so that place = character + word
        source, target = start + word[start], start + length + word[start]
        step = start + length - (stop - n)[word[start]]
        order = np.argsort(step * (len(m) + len(n)) + target, kind="stable")
        source, target, piece, score, step = (c[order] for c in (source, target, piece, score, step))
        group = np.append(0, np.cumsum(target[1:] != target[:-1]))[:len(target)]
        bounds = np.searchsorted(step, np.arange(1, n.max(initial=0) + 2))
        best, came, by = np.zeros(len(m) + len(n)), np.zeros(len(m) + len(n), np.int64), np.zeros(len(m) + len(n), np.int32)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            reach, g = best[source[lo:hi]] + score[lo:hi], group[lo:hi] - group[lo]
            top = np.maximum.reduceat(reach, np.flatnonzero(np.append(True, g[1:] != g[:-1])))
            won = np.flatnonzero(reach == top[g])
            won = lo + won[np.append(True, g[won[1:]] != g[won[:-1]])]  # the longest of equal ones
            best[target[won]], came[target[won]], by[target[won]] = top, source[won], piece[won]
        on, first = np.zeros(len(best), bool), stop - n + np.arange(len(n))
        at = (stop + np.arange(len(n)))[n > 0]
        first = first[n > 0]
        while len(at):
            on[at] = True
            at = came[at]
            at, first = at[at > first], first[at > first]
        ends = np.flatnonzero(on)
        owner = np.searchsorted(stop + np.arange(len(n)), ends)
        ids, spelt = by[ends], by[ends] < 0
        size = np.ones(len(ends), np.int64)
        char = ends[spelt] - owner[spelt] - 1
        size[spelt] = np.append(char_at, len(buf))[char + 1] - char_at[char]
        ids = np.repeat(ids, size)
        k = np.arange(size[spelt].sum()) - np.repeat(np.cumsum(size[spelt]) - size[spelt], size[spelt])
        ids[np.repeat(spelt, size)] = self.byte_ids[buf[np.repeat(char_at[char], size[spelt]) + k]]
        return np.bincount(owner, size, len(n)).astype(np.int64), ids


def _gather(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` one after another."""
    off = np.cumsum(size) - size
    return ids[np.arange(size.sum()) + np.repeat(first - off, size)]


def _list(numbers: np.ndarray) -> pa.Array:
    """One row with all the numbers, in as few bytes as the largest takes."""
    small = pa.array(numbers.astype(np.min_scalar_type(numbers.max(initial=0))))
    return pa.ListArray.from_arrays(pa.array([0, len(small)], pa.int32()), small)


def best_paths(words: DataFrame, pieces: Pieces) -> DataFrame:
    """part, word, ids for the distinct (part, word) of ``words``: the lattice of every word."""
    shared = words.sparkSession.sparkContext.broadcast(Lattice(pieces))  # fixed by the model

    def run(batches):
        for b in batches:
            first, size, ids = shared.value.paths(b.column(1).cast(pa.binary()))
            off = np.append(0, np.cumsum(size)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(_gather(ids, first, size)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["part", "word", "ids"])
    return words.select("part", "word").mapInArrow(run, "part int, word string, ids array<int>")


def cut_words(t, blank_cuts: bool = True, line_cuts: bool = True):
    """Words of every row of a block: (start, end, word_off) over a buffer with the leading blanks."""
    size = np.diff(t.off)
    extra = (size > 0).astype(np.int64)
    off = np.append(0, np.cumsum(size + extra))
    buf = np.full(off[-1], 0x20, np.uint8)
    text = np.ones(len(buf), bool)
    text[off[:-1][extra > 0]] = False
    buf[text] = t.buf
    new = np.zeros(len(buf) + 1, bool)
    if blank_cuts:
        blank = buf == 0x20
        new[:-1] = blank
        new[1:-1] &= ~blank[:-1]
    if line_cuts:
        line = buf == 0x0A
        new[:-1] |= line
        new[1:] |= line
    new[off] = True
    start = np.flatnonzero(new[:-1])
    end = np.append(start[1:], len(buf))
    return buf, start, end, np.searchsorted(start, off)


def _distinct(buf, start, end):
    """(a word's number for each distinct word, index per word, hashes), told apart by 128 bits of hash."""
    h1, h2 = H.word_hash(buf, start, end, 41), H.word_hash(buf, start, end, 42)
    order = np.argsort(h1)
    new = np.append(True, h1[order][1:] != h1[order][:-1])[:len(order)]
    if (h2[order][1:] != h2[order][:-1])[~new[1:]].any():  # two words with one first hash
        order = np.lexsort((h2, h1))
        new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    first = order[new]
    return first, index, h1[first]


def _strings(buf, start, end) -> pa.Array:
    size = end - start
    off = np.append(0, np.cumsum(size)).astype(np.int32)
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(buf[at])])


SCHEMA = "doc_id long, n_words long, n_pieces long, ids array<int>, decoded_sha256 string, exact boolean"


def encode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): SCHEMA. ``decoded_sha256`` is of the text that
    the ids decode to, ``exact`` whether that is the text. The blocks of texts stay in the
    shared folder until the program ends, because the result is read from them."""
    spark = docs.sparkSession
    pieces = pieces or Pieces()
    store = Blocks(docs)
    n_parts = store.n_parts
    atexit.register(_drop, store)

    cuts = pieces.blank_cuts, pieces.line_cuts
    shared = spark.sparkContext.broadcast(Lattice(pieces))  # fixed by the model

    def ask(t, block):
        buf, start, end, _ = cut_words(t, *cuts)
        first, _, h = _distinct(buf, start, end)
        for p, i in split_by_part(H.part_of(h, n_parts), n_parts):
            yield p, pack(TIGHT, word=_strings(buf, start[first[i]], end[first[i]]), part=np.full(len(i), p, np.int32))

    def reply(got):
        words = pc.unique(pa.chunked_array([c for _, t in got for c in t.column("word").chunks]))
        first, size, ids = shared.value.paths(words)
        for block, t in got:
            at = pc.index_in(t.column("word").combine_chunks(), value_set=words).to_numpy()
            yield block, pack(TIGHT, size=_list(size[at]), ids=_list(_gather(ids, first[at], size[at])),
                              part=t.column("part").to_numpy()[:1])

    replies = answer(store.ask(ask), reply)
    table = pieces.text

    def settle(t, replies):
        buf, start, end, word_off = cut_words(t, *cuts)
        first, index, h = _distinct(buf, start, end)
        sent = dict(split_by_part(H.part_of(h, n_parts), n_parts))
        size = np.zeros(len(first), np.int64)
        begin = np.zeros(len(first), np.int64)
        pool, at = [np.zeros(0, np.int32)], 0
        for r in replies:
            i = sent[r.column("part")[0].as_py()]
            n, ids = r.column("size")[0].values.to_numpy(), r.column("ids")[0].values.to_numpy()
            size[i], begin[i] = n, at + np.cumsum(n) - n
            pool.append(ids)
            at += len(ids)
        pool = np.concatenate(pool)
        n = size[index]
        off = np.append(0, np.cumsum(n))
        ids = pool[np.arange(off[-1]) + np.repeat(begin[index] - off[:-1], n)]
        row_off = off[word_off]
        digest, exact = [], []
        for i, valid in enumerate(t.valid):
            text = decode_ids(ids[row_off[i]:row_off[i + 1]], table) if valid else None
            digest.append(hashlib.sha256(text).hexdigest() if valid else None)
            exact.append(text == t.bytes_of(i) if valid else None)
        mask = pa.array(~t.valid)
        return {"doc_id": t.keys, "n_words": np.diff(word_off), "n_pieces": np.diff(row_off),
                "ids": pa.ListArray.from_arrays(pa.array(row_off.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=mask),
                "decoded_sha256": digest, "exact": exact}

    return store.settle(replies, settle, SCHEMA)


def _drop(store: Blocks) -> None:
    if store.spark.sparkContext._jsc is not None:  # the session may have been stopped before
        store.drop()


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The text of one list of ids: its pieces without the leading blank."""
    return b"".join([table[i] for i in ids.tolist()])[1:]


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) as doc_id, text."""
    table = (pieces or Pieces()).text

    def run(batches):
        for b in batches:
            text = [None if x is None else decode_ids(np.asarray(x, np.int64), table).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and proof that they decode to its text."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
