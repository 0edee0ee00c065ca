"""Stored postings: keyword search that reads only the terms it asks for.

``<root>/postings`` holds one row per term and text, (term, key, tf, gen), partitioned by a hash bucket of
the term; ``<root>/indexed`` holds (key, text_hash, gen): which writing of a text counts. A batch adds the
texts that are new or have changed under the next ``gen``, the rows of older writings stay and no longer
count. ``indexed`` is written last, and no ``gen`` is used twice: what a batch that failed before had written
is under a ``gen`` that no text has, and does not count. Rows that a table holds twice under one ``gen`` count
once; ``<root>/batches`` holds how many rows each ``gen`` has, (gen, n), so that this is looked for only where there are more. A search reads the buckets of its terms and ``indexed``, never a
text.

Defined cases: a null or blank text is indexed without terms, so that searches by negatives only find it,
as they do on texts without those words. Rows are one per key; null keys are left out.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators.search import _norm_terms, _raw_tokens
from caseflow.sources import sinks as sk

BUCKETS = 64


class Postings:
    """The postings of one text column, stored under ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "encounter_id", key_type: str = "long", buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets
        self.posting = f"term string, {key} {key_type}, tf long, gen int, bucket int"
        self.entry = f"{key} {key_type}, text_hash long, gen int"

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def add(self, texts: DataFrame, text_col: str) -> None:
        """Index the rows of ``texts`` (key, text) that are new or whose text has changed."""
        rows = texts.where(F.col(self.key).isNotNull()).select(
            F.col(self.key), F.col(text_col).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("\u0000null"))).alias("text_hash"))
        gen = 1
        if sk.table_exists(self.spark, f"{self.root}/indexed"):
            now = self.current().join(sk.small_keys(rows, self.key), self.key, "left_semi")
            rows = rows.join(now.drop("gen"), [self.key, "text_hash"], "left_anti")
        used = [self._read(name, "gen int").agg(F.max("gen")).first()[0] or 0  # postings: a batch that failed before, too
                for name in ("indexed", "postings") if sk.table_exists(self.spark, f"{self.root}/{name}")]
        gen += max(used, default=0)
        scratch: list[str] = []
        rows = sk.roundtrip(self.spark, rows, "to-index", scratch=scratch)
        from caseflow.rules.stopwords import ENGLISH_STOP_WORDS
        terms = term_counts(rows, self.key, "_text").where(~F.col("term").isin(ENGLISH_STOP_WORDS))
        out = terms.select("term", self.key, "tf", F.lit(gen).alias("gen"), F.pmod(F.crc32("term"), F.lit(self.buckets)).cast("int").alias("bucket"))
        # sorted by term inside a bucket's files, so that a term's rows are few row groups
        (out.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket")
         .parquet(f"{self.root}/postings"))
        written = self._counts().where(F.col("gen") == gen)
        sk.append(written, f"{self.root}/batches")
        sk.append(rows.select(self.key, "text_hash", F.lit(gen).alias("gen")), f"{self.root}/indexed")
        sk.discard(self.spark, scratch)

    def _counts(self) -> DataFrame:
        """(gen, n): the stored rows of each ``gen``."""
        return self._read("postings", self.posting).groupBy("gen").agg(F.count(F.lit(1)).alias("n"))

    def once(self) -> bool:
        """Whether every ``gen`` that texts have holds as many rows as its batch wrote, that is, none twice."""
        if not sk.table_exists(self.spark, f"{self.root}/batches"):
            return False
        counts = self._counts().join(self._read("indexed", self.entry).select("gen").distinct(), "gen", "left_semi")
        return counts.join(self._read("batches", "gen int, n long"), ["gen", "n"], "left_anti").isEmpty()

    def current(self) -> DataFrame:
        """(key, text_hash, gen) of the texts that count."""
        t = self._read("indexed", self.entry)
        return t.groupBy(self.key).agg(F.max_by("text_hash", "gen").alias("text_hash"), F.max("gen").alias("gen"))

    def rows_of(self, terms: list[str]) -> DataFrame:
        """(term, key, tf) of the current texts that hold one of the terms."""
        buckets = sorted({crc32(t.encode()) % self.buckets for t in terms})
        hits = self._read("postings", self.posting).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        hits = hits.groupBy("term", self.key, "gen").agg(F.max("tf").alias("tf"))
        return hits.join(self.current().select(self.key, "gen"), [self.key, "gen"], "left_semi").select("term", self.key, "tf")

    def rank(self, positive=None, negative=None) -> DataFrame:
        """(key, r): texts with any positive term and no negative one, and the summed frequency of the
        positive terms. With negatives only, every text free of them (r = 0); with neither, nothing."""
        pos, neg = _norm_terms(positive), _norm_terms(negative)
        if pos:
            found = self.rows_of(pos).groupBy(self.key).agg(F.sum("tf").alias("r"))
        else:
            found = self.current().select(self.key, F.lit(0).cast("long").alias("r"))
            found = found if neg else found.limit(0)
        return found.join(self.rows_of(neg).select(self.key), self.key, "left_anti") if neg else found

    def keys(self, positive=None, negative=None) -> DataFrame:
        return self.rank(positive, negative).select(self.key)

    def document_frequency(self) -> DataFrame:
        """(term, doc_freq) over the current texts."""
        rows = self._read("postings", self.posting).select("term", self.key, "gen")
        rows = rows if self.once() else rows.distinct()
        rows = rows.join(self.current().select(self.key, "gen"), [self.key, "gen"], "left_semi")
        return rows.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def term_counts(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term, tf): the terms of each row with how often they occur in it, counted in the row itself: the
    tokens are sorted, and a term's count is the length of its run."""
    rows = rows.select(key, F.sort_array(_raw_tokens(text_col)).alias("_tok"))
    starts = F.filter(F.transform("_tok", lambda t, i: F.when((i == 0) | (F.get("_tok", i - 1) != t), i)), lambda i: i.isNotNull())
    rows = rows.select(key, "_tok", starts.alias("_at"))
    runs = F.transform("_at", lambda at, j: F.struct(
        F.get("_tok", at).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_tok")) - at).cast("long").alias("tf")))
    return rows.select(key, F.explode(runs).alias("_run")).select(key, "_run.term", "_run.tf")


def stemmed_keys(df: DataFrame, key: str, text_col: str, positive=None, negative=None) -> DataFrame:
    """Keyword match by stems: keys of texts that hold a form of any positive word and of no negative one.

    The stems of the distinct terms are written before they are searched: a filter on the stem would
    otherwise move below the distinct, and stem a term once for every text that holds it. Texts are then
    searched for the terms of the asked stems."""
    from caseflow.functions.stems import stem_table, text_terms
    spark, pos, neg = df.sparkSession, _norm_terms(positive), _norm_terms(negative)
    if not pos and not neg:
        return df.select(key).limit(0)
    rows, scratch = text_terms(df, key, text_col), []
    stems = sk.roundtrip(spark, stem_table(rows), "stems", scratch=scratch)

    def having(words):
        asked = stem_table(spark.createDataFrame([(w,) for w in words], "term string")).select("stem").distinct()
        forms = stems.join(F.broadcast(asked), "stem", "left_semi").select("term")  # asked: the words of one query
        return rows.join(sk.roundtrip(spark, forms, "forms"), "term", "left_semi").select(key).distinct()
    out = having(pos) if pos else df.where(F.col(text_col).isNotNull()).select(key).distinct()
    out = out.join(having(neg), key, "left_anti") if neg else out
    sk.discard(spark, scratch)
    return out
