"""Text vectors by feature hashing, sparse cosine, sentence chunking, relevance scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as tx
from caseflow.rules.vocab import CHUNK_MAX_TOKENS, CHUNK_SIMILARITY

SMALL_DIM, LARGE_DIM = 64, 1024


def term_bucket(term, dim: int):
    """Bucket of a term: the first 32 bits of its md5, modulo the dimension."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim


def hash_embed(df: DataFrame, key: str, text_col: str, dim: int = SMALL_DIM) -> DataFrame:
    """Sparse L2-normalised term-frequency vectors: (key, bucket, weight).

    Counts are pre-aggregated per (key, bucket) before the norm is taken per key, so
    what is shuffled is at most one row per distinct bucket of a text, not its tokens.
    """
    from caseflow.rules.stopwords import ENGLISH_STOP_WORDS
    # explode first, then drop stop words with IN over a literal list (a hash-set test
    # in generated code) instead of a per-token lambda over the stop-word array
    toks = (df.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"), 0))
                      .alias("t"))
            .where(~F.col("t").isin(ENGLISH_STOP_WORDS)))
    counts = toks.groupBy(key, term_bucket(F.col("t"), dim).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("c") / norm).alias("weight"))


def dense_embed(df: DataFrame, key: str, text_col: str, dim: int = SMALL_DIM) -> DataFrame:
    """(key, vec): the same vectors at their fixed length, of unit length.

    One aggregate gathers a text's counts (at most ``dim``) in bucket order; each count then brings
    the zeros before it, so the array is written once from left to right without look-ups.
    Texts without a term have no row; ``with_vectors`` gives them zeros.
    """
    from caseflow.rules.stopwords import ENGLISH_STOP_WORDS
    toks = (df.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"), 0)).alias("t"))
            .where(~F.col("t").isin(ENGLISH_STOP_WORDS)))
    counts = toks.groupBy(key, term_bucket(F.col("t"), dim).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    rows = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bucket", "c"))).alias("_e"),
                                   F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_norm"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    before = F.concat(F.array(F.lit(-1)), F.col("_e.bucket"))
    pieces = F.zip_with("_e", F.slice(before, F.lit(1), F.size("_e")), lambda x, last: F.concat(
        zeros(x["bucket"] - last - 1), F.array(x["c"] / F.col("_norm"))))
    return rows.select(key, F.concat(F.flatten(pieces), zeros(dim - 1 - F.element_at("_e.bucket", -1))).alias("vec"))


def with_vectors(df: DataFrame, key: str, text_col: str, dim: int = SMALL_DIM) -> DataFrame:
    """``df`` (one row per key) with the vector of its text as ``vec``, in floats as stored; all zeros without terms."""
    none = F.array_repeat(F.lit(0.0), dim)
    out = df.join(dense_embed(df, key, text_col, dim), key, "left")
    return out.select(*df.columns, F.coalesce("vec", none).cast("array<float>").alias("vec"))


def keep_vectors(df: DataFrame, stored: DataFrame | None, key: str, text_col: str, dim: int = SMALL_DIM) -> DataFrame:
    """``df`` with vectors: that of the stored row of the same key where the text is the same, a new one
    where the text is new or has changed."""
    if stored is None:
        return with_vectors(df, key, text_col, dim)
    old = stored.select(key, F.col(text_col).alias("_text"), "vec")
    both = df.join(old, key, "left")
    same = F.col("vec").isNotNull() & F.col("_text").eqNullSafe(F.col(text_col))
    changed = both.where(~same).select(*df.columns)
    return both.where(same).select(*df.columns, "vec").unionByName(with_vectors(changed, key, text_col, dim))


def embed_query(text: str, small: bool = False) -> list[float]:
    """The vector of one query text, built as the stored ones are."""
    import hashlib
    import re
    from collections import Counter
    from caseflow.rules.stopwords import ENGLISH_STOP_WORDS
    dim = SMALL_DIM if small else LARGE_DIM
    terms = [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in ENGLISH_STOP_WORDS]
    counts = Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in terms)
    norm = sum(c * c for c in counts.values()) ** 0.5
    return [counts[i] / norm if norm else 0.0 for i in range(dim)]


def sparse_cosine(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Cosine of two unit-length sparse vectors per key: equi-join on (key, bucket) and sum."""
    j = a.withColumnRenamed("weight", "wa").join(b.withColumnRenamed("weight", "wb"), [key, "bucket"], "inner")
    return j.groupBy(key).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def sentences(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, sent_no, sentence, n_tokens): sentences are runs up to and including . ! ?"""
    parts = F.filter(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"[^.!?]+[.!?]*"), 0),
                                 lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    s = df.select(key, F.posexplode(parts).alias("sent_no", "sentence"))
    return s.withColumn("n_tokens", F.size(F.split("sentence", r"\s+")))


def _pack(sizes, max_tokens: int, breaks=None) -> list[int]:
    """Greedy packing: chunk number of each sentence (a new chunk when the current one
    is empty, the sentence would overflow it, or a topic break is flagged)."""
    out, no, used = [], -1, 0
    for j, n in enumerate(sizes):
        if used == 0 or used + n > max_tokens or (breaks is not None and breaks[j]):
            no, used = no + 1, n
        else:
            used += n
        out.append(no)
    return out


def _chunk_rows(k, sents, sizes, max_tokens, breaks=None):
    groups: dict[int, list] = {}
    for no, s, n in zip(_pack(sizes, max_tokens, breaks), sents, sizes):
        g = groups.setdefault(no, [[], 0])
        g[0].append(s)
        g[1] += int(n)
    return [(k, no, " ".join(ss), n) for no, (ss, n) in groups.items()]


def chunk_by_size(df: DataFrame, key: str, text_col: str, max_tokens: int = CHUNK_MAX_TOKENS) -> DataFrame:
    """Greedy packing of whole sentences into chunks of at most ``max_tokens`` tokens
    (a longer sentence is a chunk of its own); chunks numbered from 0 per text.

    Sentence cutting and token counts are built-in expressions; the packing itself is
    sequential within a text, so it runs in ``mapInPandas`` over Arrow batches of
    (key, sentences, sizes) rows — texts are independent and stay where Spark put them
    (no shuffle), and each text is handled in one linear pass.
    """
    parts = F.filter(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"[^.!?]+[.!?]*"), 0),
                                 lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    staged = df.select(F.col(key).alias("_k"), parts.alias("_s")).select(
        "_k", "_s", F.transform("_s", lambda s: F.size(F.split(s, r"\s+"))).alias("_n"))

    def run(batches):
        import pandas as pd
        cols = ["_k", "chunk_number", "chunk_text", "n_tokens"]
        for b in batches:
            rows = []
            for k, sents, sizes in zip(b["_k"], b["_s"], b["_n"]):
                if sents is not None and len(sents) > 0:
                    rows.extend(_chunk_rows(k, list(sents), list(sizes), max_tokens))
            yield pd.DataFrame(rows, columns=cols)

    key_type = dict(df.dtypes)[key]
    out = staged.mapInPandas(run, schema=f"_k {key_type}, chunk_number int, chunk_text string, n_tokens long")
    return out.withColumnRenamed("_k", key)


def chunk_texts(df: DataFrame, key: str, text_col: str, max_tokens: int = CHUNK_MAX_TOKENS,
                threshold: float = CHUNK_SIMILARITY) -> DataFrame:
    """Size rule plus a topic break: a new chunk also starts when a sentence's term set
    overlaps the previous sentence's by less than ``threshold`` (Jaccard).

    Sentences are exploded to rows so that term extraction and the overlap with the
    previous sentence (``lag`` within the text) run as generated code; only the cheap
    sequential packing is a fold over each text's sentence list. The window and the
    regrouping share one shuffle on the text key; a text's sentences are bounded by
    the text itself.
    """
    parts = F.filter(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"[^.!?]+[.!?]*"), 0),
                                 lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    sents = (df.select(key, F.posexplode(parts).alias("i", "s"))
             .withColumn("n", F.size(F.split("s", r"\s+")))
             .withColumn("terms", tx.search_terms(F.col("s"))))
    empty = F.array().cast("array<string>")
    prev = F.coalesce(F.lag("terms").over(Window.partitionBy(key).orderBy("i")), empty)
    inter = F.size(F.array_intersect(prev, F.col("terms")))
    union = F.size(F.array_union(prev, F.col("terms")))
    topic = F.when(union > 0, inter / union).otherwise(F.lit(1.0)) < threshold
    rows = (sents.select(key, "i", "n", "s", topic.alias("topic"))
            .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "n", "topic", "s"))).alias("_rows"))
            .select(F.col(key).alias("_k"), F.col("_rows.s").alias("_s"), F.col("_rows.n").alias("_n"),
                    F.col("_rows.topic").alias("_t")))

    def run(batches):
        import pandas as pd
        for b in batches:
            out = []
            for k, ss, ns, ts in zip(b["_k"], b["_s"], b["_n"], b["_t"]):
                out.extend((k, no, text) for k, no, text, _ in _chunk_rows(k, list(ss), list(ns), max_tokens,
                                                                           list(ts)))
            yield pd.DataFrame(out, columns=["_k", "chunk_number", "chunk_text"])

    key_type = dict(df.dtypes)[key]
    return (rows.mapInPandas(run, schema=f"_k {key_type}, chunk_number int, chunk_text string")
            .withColumnRenamed("_k", key))


def overlap_relevance(df: DataFrame, text_col: str, query: str) -> DataFrame:
    """Stand-in relevance: logits (no = 1, yes = number of query terms in the text),
    p(yes) by the two-logit softmax."""
    import re
    q = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    qarr = F.array(*[F.lit(t) for t in q])
    yes = F.size(F.array_intersect(tx.search_terms(F.col(text_col)), qarr)).cast("double")
    return df.withColumn("relevance", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.0) - yes)))
