"""Benchmark decontamination: normalised test n-grams in a broadcast hash set.

Items are lower-cased (A-Z) and cut into words; every ``size`` consecutive words are a
window, an item of fewer words is one window. The distinct windows of all items are a
table keyed by a 64-bit hash of their first, middle and last word. Training texts are cut
the same way, each word start probes the table, and a probe counts only if all words are
equal. Everything is built-in functions, and a text's windows are made, probed and dropped
inside one generated stage; what is shuffled is one small row per document.

The window table is broadcast when its measured size is at most ``broadcast_bytes``;
otherwise the windows of the texts are shuffled to it.

Defined cases: null text has no words; null items are skipped, items with a null id hit
but are not listed; rows are told apart by doc_id and text, so repeated rows each get
their own result; an empty benchmark hits nothing. Extra columns are ignored by ``scan``
and kept by ``drop_documents`` and ``cut_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.text import fresh

KEY, MARK = "doc_id", "_text_mark"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters and digits and of all other characters above
    ASCII. One pass turns A-Z to a-z and every other ASCII character to a blank."""
    plain = F.translate(text, LETTERS.upper() + BREAKS, LETTERS + " " * len(BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def _probe(w, at, n) -> Column:
    """The hash that finds the window of n words of ``w`` from the 1-based place ``at``."""
    return F.xxhash64(F.get(w, at - 1), F.get(w, at - 1 + F.floor(n / 2).cast("int")), F.get(w, at + n - 2))


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows of the items: key, gram (its words), n, items (ids, as sorted strings)."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    n = F.least(F.size("w"), F.lit(size))
    w = w.where(F.size("w") > 0).select("item", "w", n.alias("n"),
                                        F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    gram = w.select("item", "n", F.slice("w", F.col("i"), F.col("n")).alias("gram"))
    return (gram.groupBy("gram", "n").agg(F.collect_set("item").alias("items"))
            .select(_probe(F.col("gram"), F.lit(1), F.col("n")).alias("key"), "gram", "n", "items"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per distinct (doc_id, text) of ``docs``: doc_id, mark (hash of the text), rows (how many
    there are), n_words, covered (sorted 0-based word positions under any hit), items (sorted ids)."""
    windows = benchmark_windows(benchmark, size)
    stats = windows.agg(F.collect_set("n"), F.sum(F.octet_length(F.array_join("gram", " ")) + 16 * F.size("gram")
                                                  + 24 * F.size("items"))).first()
    lengths, measured = sorted(stats[0]) or [size], stats[1] or 0
    k = len(lengths)  # at most `size`
    w = docs.select(KEY, F.xxhash64("text").alias(MARK), words_of(F.coalesce("text", F.lit(""))).alias("w"))
    # one row with `at` -1 for the document itself, then one per window
    at = w.select(KEY, MARK, "w", F.explode(F.sequence(F.lit(-1), F.size("w") * k - 1)).alias("at"))
    pos = F.floor(F.col("at") / k).cast("int") if k > 1 else F.col("at")
    n = F.element_at(F.array(*map(F.lit, lengths)), F.pmod(F.col("at"), F.lit(k)) + 1) if k > 1 else F.lit(lengths[0])
    at = at.select(KEY, MARK, "w", pos.alias("pos"), n.alias("len"))
    at = at.where((F.col("pos") < 0) | (F.col("pos") + F.col("len") <= F.size("w")))
    key = F.when(F.col("pos") >= 0, _probe(F.col("w"), F.col("pos") + 1, F.col("len")))
    words = F.slice("w", F.col("pos") + 1, F.col("len"))
    if measured <= broadcast_bytes:
        found = at.withColumn("key", key).join(F.broadcast(windows), "key", "left")
        hit = F.when(F.col("gram").isNotNull(), words == F.col("gram"))
    else:
        at = at.select(KEY, MARK, F.size("w").alias("size"), "pos", key.alias("key"),
                       F.when(F.col("pos") >= 0, words).alias("gram"))
        found = at.join(windows, ["key", "gram"], "left")
        hit = F.col("n").isNotNull()
    n_words = F.size("w") if measured <= broadcast_bytes else F.col("size")
    found = found.select(KEY, MARK, "pos", "n", "items", F.when(F.col("pos") < 0, n_words).alias("n_words"), hit.alias("hit"))
    per = found.where("n_words IS NOT NULL OR hit").groupBy(KEY, MARK).agg(
        F.count("n_words").alias("rows"), F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("hit"), F.struct("pos", "n"))).alias("h"),
        F.collect_set(F.when(F.col("hit"), F.col("items"))).alias("items"))
    reach = F.transform("h", lambda h: F.sequence(h["pos"], h["pos"] + h["n"] - 1))
    return per.select(KEY, MARK, "rows", "n_words", F.array_sort(F.array_distinct(F.flatten(reach))).alias("covered"),
                      F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def _marked(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to the results ``found`` (doc_id, mark, ...) of their texts."""
    mark, key = fresh(docs, MARK), fresh(docs, "_found_id")
    f = found.withColumnRenamed(KEY, key).withColumnRenamed(MARK, key + "_mark")
    d = docs.withColumn(mark, F.xxhash64("text"))
    return d.join(f, F.col(KEY).eqNullSafe(F.col(key)) & (F.col(mark) == F.col(key + "_mark")), how)


def drop_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, columns unchanged."""
    hit = scan(docs, benchmark, size).where(F.size("covered") > 0).select(KEY, MARK)
    return _marked(docs, hit, "left_anti").select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with the hit words, and the separators before them, cut from the text."""
    covered = fresh(docs, "_covered")
    found = scan(docs, benchmark, size).where(F.size("covered") > 0).select(KEY, MARK, F.col("covered").alias(covered))
    marked = _marked(docs, found, "left")
    sep = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all("text", F.lit(f"{sep}*{word}+"), F.lit(0))
    tail = F.regexp_extract("text", f"{sep}*$", 0)
    kept = F.filter(pieces, lambda p, i: ~F.array_contains(covered, i))
    text = F.when(F.col(covered).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return marked.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(KEY, "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))))  # repeated rows each get their result
    n_hit = F.size("covered").cast("long")
    return each.select(KEY, F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
