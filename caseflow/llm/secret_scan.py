"""Secret scan with a password guess-cost.

Three fixed patterns give the base spans. Values in a wider credential context (``pwd=``,
``auth:``, ``bearer ...``) are judged by how many guesses they would take: the cheapest
segmentation of the value into dictionary words, dates, repeats, keyboard walks and
brute-force spans, found by dynamic programming over its characters. A value whose
cost reaches ``min_guesses`` (log10) is added as a span of kind ``guess``; base spans stay.

The dictionary is the words that most distinct texts hold, at most ``dictionary_words`` (the bound
keeps the broadcast small; words of equally many texts are in or out together), behind a short list
of common passwords. Copies of a text count
once and the values of credential contexts not at all, so a secret does not become a word by
being spread. The scan itself is one pass over the texts without a shuffle.

Defined cases: null counts as empty text, which has no spans; an empty table gives no rows; a value
or run of any length is judged whole, in time that grows with it. Rows are judged by text alone
against one dictionary, so repeated rows agree; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import reduce
from math import log10
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.blocks import discard, written
from caseflow.llm.text import lower_ascii

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(r"""(pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|login|"""
                     r"""(?:api|access|private|client)[_-]?(?:key|secret|token))["']?"""
                     r"""(?:\x20*(?:=>|[:=])\x20*(?:bearer\x20+)?|(?<=bearer)\x20+)["']?([^\s"'<>,;]{8,})""", re.I | re.A)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")
# fixed values: common passwords, most frequent first
COMMON = ("123456 password qwerty letmein admin welcome monkey dragon abc123 iloveyou football master login princess "
          "sunshine shadow passw0rd secret changeme default root test guest user").split()
LEET = str.maketrans("4@31!0$57", "aaeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT_TO = {a + b for row in ROWS for a, b in zip(row, row[1:])} | {b + a for row in ROWS for a, b in zip(row, row[1:])}
DATES = (re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"),
         re.compile(r"(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|1[0-2])\1(?:19|20)?\d\d"), re.compile(r"(?:19|20)\d\d"))
DAYS = log10(366 * 120)
JOINT = 0.7  # a further segment: where it begins and in which order


def brute(c: str) -> float:
    """log10 of the choices for one character tried blindly."""
    return log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


class Ranks(dict):
    """The rank of every word, and the lengths that words have (``lengths``)."""

    def __init__(self, ranks):
        super().__init__(ranks)
        self.lengths = sorted({len(w) for w in self} - {1, 2})


def words_and_dates(value: str, ranks: dict[str, int]):
    """(start, end, kind, log10 guesses) of every word and date in ``value``. Only lengths that words
    of the dictionary have are looked up, so their number grows with the length of the value."""
    lengths = ranks.lengths if isinstance(ranks, Ranks) else Ranks(ranks).lengths
    low = value.lower()
    if len(low) != len(value):
        low = value
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for size in lengths:
            j = i + size
            if j > n:
                break
            for text, extra in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                rank = ranks.get(text)
                if rank and (extra == 0.0 or plain[i:j] != low[i:j]):
                    upper = sum(map(str.isupper, value[i:j]))
                    yield i, j, "word", log10(rank) + extra + (0 if not upper else 0.3 if upper in (1, j - i) else 0.3 * upper)
        for d in DATES:
            m = d.match(value, i)
            if m:
                yield i, m.end(), "date", 2.1 if m.end() - i == 4 else DAYS


def segments(value: str, ranks: dict[str, int]):
    """(start, end, kind, log10 guesses) of every word, date, repeat and walk in ``value``: what
    ``guess_cost`` chooses from, listed one by one (their number grows with the square of a run)."""
    yield from words_and_dates(value, ranks)
    low = value.lower()
    if len(low) != len(value):
        low = value
    run = walk = 1
    for j in range(len(value)):
        if j:
            run = run + 1 if low[j] == low[j - 1] else 1
            walk = walk + 1 if low[j - 1:j + 1] in NEXT_TO else 1
        for k in range(3, run + 1):
            yield j - k + 1, j + 1, "repeat", brute(low[j]) + log10(k)
        for k in range(3, walk + 1):
            yield j - k + 1, j + 1, "walk", log10(47) + 0.3 * (k - 1)


class Repeats:
    """The cheapest repeat that ends at each place of one run of equal characters.

    A repeat of k characters costs log10(k) more than where it starts. That is concave in k: of two
    starts, the earlier one can only get cheaper in comparison as the end moves on. So starts are kept
    on a stack with the end from which on each is passed by the one below it, found by bisection; the
    top is the cheapest one now. Every start enters and leaves once: O(n log n) for a run, exactly.
    """

    def __init__(self):
        self.stack: list[tuple[int, float, float]] = []  # start, cost there, end from which on the one below is cheaper

    @staticmethod
    def _passed(old, new) -> float:
        """The first end at which ``old`` (earlier start) costs no more than ``new``: cost + log10(end - start)."""
        lead = new[1] - old[1]
        if lead <= 1e-15:
            return float("inf")  # the shorter one starts no dearer: it stays cheaper
        if lead > 300:
            return float(new[0])
        ratio = 10 ** lead  # end - old <= (end - new) * ratio
        return (new[0] * ratio - old[0]) / (ratio - 1)

    def push(self, start: int, cost: float) -> None:
        new = (start, cost)
        while self.stack:
            end = self._passed(self.stack[-1], new)
            if end <= start + 3:
                return  # an earlier start is cheaper from the first end of the new one on
            if end < self.stack[-1][2]:
                self.stack.append((*new, end))
                return
            # the one on top would be passed by the one below it before it passes the new one
            self.stack.pop()
        self.stack.append((*new, float("inf")))

    def cheapest(self, end: int) -> float:
        while len(self.stack) > 1 and self.stack[-1][2] <= end:
            self.stack.pop()
        start, cost, _ = self.stack[-1]
        return cost + log10(end - start)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses for ``value``: the cheapest segmentation, brute force filling the gaps.

    Time and memory grow with the length (times its logarithm): sub-repeats and sub-walks of a run are
    not listed. A walk costs 0.3 a character from where it starts, so the cheapest start of a run is a
    running minimum; repeats see ``Repeats``."""
    ends: dict[int, list] = {}
    for i, j, _, cost in words_and_dates(value, ranks):
        ends.setdefault(j, []).append((i, cost))
    low = value.lower()
    if len(low) != len(value):
        low = value
    best, blind = [-JOINT], float("inf")  # best: any segmentation up to here; blind: one that ends in brute force
    run = walk = 1  # lengths of the repeat and of the walk that end here
    repeats, lowest = Repeats(), float("inf")
    for j in range(1, len(value) + 1):
        c = brute(value[j - 1])
        blind = min(best[j - 1] + JOINT, blind) + c
        now = min([blind, *(best[i] + JOINT + cost for i, cost in ends.get(j, ()))])
        if j > 1:
            if low[j - 1] == low[j - 2]:
                run += 1
            else:
                run, repeats = 1, Repeats()
            if low[j - 2:j] in NEXT_TO:
                walk += 1
            else:
                walk, lowest = 1, float("inf")
        if run >= 3:  # a repeat may start three characters back
            repeats.push(j - 3, best[j - 3] + JOINT)
            now = min(now, repeats.cheapest(j) + brute(low[j - 1]))
        if walk >= 3:
            lowest = min(lowest, best[j - 3] + JOINT - 0.3 * (j - 3))
            now = min(now, lowest + 0.3 * (j - 1) + log10(47))
        best.append(now)
    return max(best[-1], 0.0)


def find_spans(text: str, ranks: dict[str, int], min_guesses: float):
    """Sorted (start, end, kind number, log10 guesses or None) of one text."""
    out = []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    taken = []
    if hinted:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                out.append((m.start(), m.end(), 0, None))
                taken.append((m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2, None) for m in HEX.finditer(text)]
    if hinted:
        begins = [a for a, _ in taken]
        for m in CONTEXT.finditer(text):
            i = bisect_right(begins, m.start(2)) - 1
            if i >= 0 and m.start(2) < taken[i][1]:
                continue  # the value of a base span
            cost = guess_cost(m[2], ranks)
            if cost >= min_guesses:
                out.append((m.start(), m.end(), 3, cost))
    return sorted(out, key=lambda s: (s[0], s[2]))


def dictionary(docs: DataFrame, dictionary_words: int) -> Ranks:
    """The words of most distinct texts with their ranks, common passwords first; values in a
    credential context are left out. The cut is at a number of texts, so that words that as many texts
    hold are in or out together: the lowest number that at most ``dictionary_words`` words reach.
    Ranks of equal words follow the alphabet. The driver gets the counts of counts (their number is at
    most the square root of twice the occurrences) and the words above the cut."""
    texts = docs.select("text").distinct().select(lower_ascii(F.col("text")).alias("t"))
    hinted = reduce(or_, [F.contains("t", F.lit(h)) for h in HINTS])
    plain = F.when(hinted, F.regexp_replace("t", CONTEXT.pattern, " ")).otherwise(F.col("t"))
    found = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    words = texts.select(F.explode(F.array_distinct(found)).alias("w"))
    scratch: list[str] = []
    counts = written(words.where(F.length("w") >= 3).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "word-counts", scratch)
    cut, total = 1, 0
    for n, many in sorted(((r["n"], r["many"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True):
        total += many
        if total > dictionary_words:
            cut = n + 1
            break
    top = sorted(((r["n"], r["w"]) for r in counts.where(F.col("n") >= cut).collect()), key=lambda x: (-x[0], x[1]))
    discard(docs.sparkSession, scratch)
    ranked = dict.fromkeys([*COMMON, *(w for _, w in top)])
    return Ranks({w: i + 1 for i, w in enumerate(ranked)})


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, "
          "found array<struct<kind: string, start: int, stop: int, log10_guesses: double>>")


def scan(docs: DataFrame, dictionary_words: int = 20_000, min_guesses: float = 10.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): SCHEMA; ``found`` lists all spans."""
    ranks = docs.sparkSession.sparkContext.broadcast(dict(dictionary(docs, dictionary_words)))

    def run(batches):
        words = Ranks(ranks.value)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = find_spans(text or "", words, min_guesses)
                names = [f"{KINDS[k]}:{a}:{z}" for a, z, k, _ in spans]
                base = ",".join(x for x, s in zip(names, spans) if s[2] < 3)
                rows.append((key, *(sum(s[2] == k for s in spans) for k in range(4)),
                             hashlib.sha256(base.encode()).hexdigest(), ",".join(names),
                             [{"kind": KINDS[k], "start": a, "stop": z, "log10_guesses": c} for a, z, k, c in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)] if rows else
                                             [pa.array([], t.type) for t in arrow], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns and credential values by guess cost."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("found")
