"""Sinks: append-only writes of new keys and child rows, the split report, upload checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import scratch_path


SMALL_KEYS = 500_000  # keys of a batch that are sent to every task rather than shuffled with the stored ones


def small_keys(rows: DataFrame, key: str, most: int = SMALL_KEYS) -> DataFrame:
    """The distinct keys of a batch, broadcast if they are counted to be few. Stored rows that are
    cut down by a semi join with them are then only scanned, not shuffled."""
    keys = rows.select(key).distinct()
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def new_keys(batch: DataFrame, stored: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Batch rows whose key is not stored yet, one per key: of several batch rows with one
    key the smallest stays (an aggregate with map-side combine, so a hot key is no hot task).
    Stored keys meet the batch's (``keys``, see ``small_keys``) first, so history is not shuffled."""
    others = [c for c in batch.columns if c != key]
    held = stored.select(key).join(small_keys(batch, key) if keys is None else keys, key, "left_semi")
    fresh = batch.join(held, key, "left_anti")
    if not others:
        return fresh.distinct()
    return (fresh.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*")
            .select(*batch.columns))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at ``path`` (a look at the file system, not a read)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, path: str) -> None:
    """Append to a parquet table; an empty input leaves a table with no rows and the schema."""
    df.write.mode("append").parquet(path)


def append_new(spark: SparkSession, batch: DataFrame, path: str, key: str, part: str | None = None,
               parts: list | None = None) -> DataFrame:
    """Append the batch rows whose key the table at ``path`` does not hold; the stored table as it is then.
    With ``part``, the table is partitioned by it and only its partitions ``parts`` are read."""
    stored = stored_rows(spark, batch, path, part, parts)
    fresh = new_keys(batch, batch.limit(0) if stored is None else stored, key)
    if part:
        fresh.hint("rebalance", F.col(part)).write.mode("append").partitionBy(part).parquet(path)
    else:
        append(fresh, path)
    return spark.read.schema(batch.schema).parquet(path)


def stored_rows(spark: SparkSession, like: DataFrame, path: str, part: str | None = None,
                parts: list | None = None) -> DataFrame | None:
    """The table at ``path`` with the columns of ``like``, of its partitions ``parts`` only; None if there is none."""
    if not table_exists(spark, path):
        return None
    t = spark.read.schema(like.schema).parquet(path)
    return t.where(F.col(part).isin(list(parts))) if part and parts is not None else t


def rewrite(spark: SparkSession, fresh: DataFrame, path: str, key: str, part: str, scratch: list[str] | None = None) -> DataFrame:
    """Put ``fresh`` into the table at ``path``, which is partitioned by ``part``: its rows take the place
    of all stored rows of the same ``key``. Only the partitions that ``fresh`` touches are read and
    overwritten, so a day's late rows cost that day. Running it again changes nothing."""
    fresh = roundtrip(spark, fresh, "fresh", scratch=scratch)
    parts = [r[0] for r in fresh.select(part).distinct().collect()]  # calendar periods: few, whatever the rows
    stored = stored_rows(spark, fresh, path, part, parts)
    if stored is not None and parts:
        kept = stored.join(small_keys(fresh, key), key, "left_anti")
        # written before the partitions are overwritten: they are read for it
        fresh = roundtrip(spark, kept.unionByName(fresh), "merged", scratch=scratch)
    if parts or stored is None:
        (fresh.hint("rebalance", F.col(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(part).parquet(path))
    return spark.read.schema(fresh.schema).parquet(path)


def append_versions(spark: SparkSession, rows: DataFrame, path: str, key: str, compare: list[str],
                    complete=None, version: str = "version") -> DataFrame:
    """Append the rows (one per key) that differ from the stored latest version of their key in a column
    of ``compare``, one version higher, and rows of new keys at version 1. ``complete`` adds derived
    columns (vectors) to what is appended, and to nothing else. The stored table as it is then."""
    rows = rows.drop(version).groupBy(key).agg(F.min(F.struct(*compare)).alias("_row")).select(key, "_row.*")
    complete = complete or (lambda df: df)
    schema = complete(rows.limit(0).withColumn(version, F.lit(0))).schema
    if table_exists(spark, path):
        stored = spark.read.schema(schema).parquet(path).select(key, version, *compare).join(small_keys(rows, key), key, "left_semi")
        last = stored.groupBy(key).agg(F.max_by(F.struct(*compare), F.col(version)).alias("_old"), F.max(version).alias("_v"))
        same = F.lit(True)
        for c in compare:
            same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
        rows = (rows.join(last, key, "left").where(F.col("_v").isNull() | ~same)
                .select(key, *compare, (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias(version)))
    else:
        rows = rows.withColumn(version, F.lit(1))
    append(complete(rows), path)
    return spark.read.schema(schema).parquet(path)


def roundtrip(spark: SparkSession, df: DataFrame, name: str, partition_by: str | None = None,
              scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and read it back (also cuts the lineage). The path is
    added to ``scratch``, for ``discard`` once nothing reads it."""
    path = scratch_path(spark, name)
    if scratch is not None:
        scratch.append(path)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    while scratch:
        p = spark._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def validate_upload(df: DataFrame, required: list[str], key: str = "encounter_id") -> tuple[DataFrame, list[str]]:
    """Reviewed-report check: the key column must exist (error otherwise); the other
    missing required columns are reported. Rows without a key are dropped."""
    if key not in df.columns:
        raise ValueError(f"upload lacks the key column {key!r}")
    missing = [c for c in required if c not in df.columns]
    return df.where(F.col(key).isNotNull()), missing
