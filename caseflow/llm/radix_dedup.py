"""Exact dedup by distributed MSD radix partitioning.

Documents start in one group and are split by successive digits of their bytes, most
significant first, until a group is a singleton or its texts have ended. Two texts are
equal when no digit tells them apart, so no digest is needed. Digits widen from level to
level, so a text of n bytes is done after O(log n) levels, and only rows still sharing
their whole prefix with another row are carried on.

A level is one aggregate by (group, digit), which collapses copies before the shuffle,
and one join of the groups of several rows back to the rows. A group of any size never
meets in one task: its rows are split over tasks by the skew handling of the join. Every level is written to the shared
folder, which cuts the lineage.

Defined cases: null counts as empty text; rows that repeat a doc_id count in
``group_size`` and share its verdict; ``keep_id`` ignores null ids unless all are null,
then it is null. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.blocks import NULL_KEY, discard, written
from caseflow.llm.text import fresh, lower_ascii
from caseflow.session import scratch_path

OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def radix_groups(docs: DataFrame, first_digit: int = 16, widen: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("rest"))
    # (key, mark) names a row; mark only tells apart rows that repeat a doc_id
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), F.xxhash64("rest").alias("mark"),
                       F.sha2("rest", 256).alias("text_sha256"), F.lit(0).cast("long").alias("group_key"),
                       F.lit(0).cast("long").alias("group_mark"), "rest")
    scratch: list[str] = []
    keep: list[str] = []
    width, ended = first_digit, None
    while True:
        rows = rows.withColumn("digit", F.substring("rest", 1, width))
        by = ["group_key", "group_mark", "digit"]
        # only groups of several rows; written, so that the join can split the rows of a large one
        groups = written(rows.groupBy(*by).agg(F.min(F.struct("key", "mark")).alias("lead"),
                                               F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep_id"))
                         .where("size > 1"), "radix-groups", scratch)
        split = rows.join(groups.hint("merge"), by, "left")  # the same plan at every size
        alone = F.col("size").isNull()
        done = alone | (F.octet_length("digit") < width)
        path = scratch_path(spark, "radix")
        out = split.select("doc_id", "key", "mark", "text_sha256", F.col("lead.key").alias("group_key"),
                           F.col("lead.mark").alias("group_mark"), F.coalesce("size", F.lit(1)).alias("size"),
                           F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                           F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"), done.alias("done"))
        out.write.partitionBy("done").parquet(path)
        level = spark.read.schema(out.schema).parquet(path)
        finished = written(level.where("done").drop("rest"), "radix-ended", keep)
        ended = finished if ended is None else ended.unionByName(finished)
        discard(spark, scratch)  # the level before, whose open rows this one has taken over
        scratch.append(path)
        rows = level.where("NOT done").drop("done", "size", "keep_id")
        width *= widen
        del split, groups, out
        if rows.isEmpty():
            break
    out = written(ended.select("doc_id", "keep_id", F.col("size").alias("group_size"),
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"), "radix-result")
    discard(spark, scratch + keep)
    return out


def keep_largest(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: of equal texts, the largest doc_id."""
    gone = fresh(docs, "_gone")
    drop = radix_groups(docs).where("NOT kept").select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(gone + "_sha"))
    mark = fresh(docs, "_sha")
    text = F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    d = docs.withColumn(mark, text)
    # the digest only tells rows that repeat a doc_id apart
    return d.join(drop.distinct(), F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(mark) == F.col(gone + "_sha")),
                  "left_anti").select(*docs.columns)


def op2_radix_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of documents equal after lower-casing A-Z; the largest doc_id of each stays."""
    return radix_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
