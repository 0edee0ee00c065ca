"""Structured Streaming jobs: daily note-dump drops, cross-drop key de-duplication and
the action log. All run with ``trigger(availableNow=True)``: every file present is
processed exactly once, progress lives in a checkpoint under the shared folder, and a
restarted job resumes where the checkpoint stops."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from caseflow.session import scratch_path
from caseflow.sources.sinks import table_exists


def tag_dump_lines(lines: DataFrame, header: list[str], key_column: str, delim: str = "|") -> DataFrame:
    """Every line of a dump parsed once: the header's columns, ``line`` and ``kind`` ("rows" or
    "rejects"). The header is given (a stream cannot look ahead); header and blank lines inside the
    files are dropped. Rows with too few fields are rejects and keep their line only, surplus fields
    go to the last column."""
    clean = F.regexp_replace(F.regexp_replace(F.col("value"), r"[^\x00-\x7F]", ""), r"^\s+|\s+$", "")
    n = len(header)
    body = lines.select(clean.alias("line")).withColumn("_f", F.split("line", re.escape(delim), -1))
    body = body.where((F.get("_f", 0) != key_column) & (F.length("line") > 0))
    good = F.size("_f") >= n
    last = F.array_join(F.slice(F.col("_f"), n, F.greatest(F.size("_f") - n + 1, F.lit(1))), " ")
    fields = [F.get(F.col("_f"), i) for i in range(n - 1)] + [last]
    return body.select(*[F.when(good, f).alias(h) for h, f in zip(header, fields)], F.when(~good, F.col("line")).alias("_line"),
                       F.when(good, F.lit("rows")).otherwise(F.lit("rejects")).alias("_kind"))


def run_file_drop(spark: SparkSession, drop_dir: str, header: list[str], key_column: str,
                  out_path: str | None = None, files_per_batch: int = 64) -> str:
    """Process every dump file in ``drop_dir`` into the table at ``out_path`` (returned; read it with
    ``read_file_drop``). ``files_per_batch`` bounds one micro-batch (a backlog of daily drops is taken
    in several batches, each a normal parallel job).

    Rows and rejects of a micro-batch are written by one job, so each file is read once and the two
    never disagree. They lie in the partitions of that batch's number, which a replayed batch
    overwrites: a run that failed between write and commit adds nothing twice. The checkpoint
    belongs to the table; one without the other is an error of the caller."""
    out_path = out_path or scratch_path(spark, "drop_table")
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
             .option("recursiveFileLookup", "true").load(drop_dir))

    def write(batch: DataFrame, epoch_id: int) -> None:
        (tag_dump_lines(batch, header, key_column).withColumn("_batch", F.lit(epoch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", "_kind").parquet(out_path))

    q = (lines.writeStream.foreachBatch(write).option("checkpointLocation", out_path + "_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def read_file_drop(spark: SparkSession, path: str, header: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the table that ``run_file_drop`` writes; both empty where nothing came yet.
    Each reads its own partitions only."""
    schema = StructType([StructField(h, StringType()) for h in [*header, "_line"]]
                        + [StructField("_batch", LongType()), StructField("_kind", StringType())])
    t = spark.read.schema(schema).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], schema)
    return (t.where(F.col("_kind") == "rows").select(*header),
            t.where(F.col("_kind") == "rejects").select(F.col("_line").alias("line")))


KEY_BUCKET_WIDTH = 1_000_000


def run_new_keys(spark: SparkSession, drop_dir: str, schema: StructType, key: str, table_path: str,
                 bucket_width: int = KEY_BUCKET_WIDTH, checkpoint: str | None = None, files_per_batch: int = 64) -> str:
    """Append only keys not yet stored. Each micro-batch is reduced to one row per key (the
    smallest), checked against the stored table as it stands (exact: no watermark, no
    state to expire), and appended. A replayed batch finds its keys stored and appends nothing.

    The stored table is partitioned by key range (``_kb``); the lookup is a semi join
    of the stored table with the batch keys on (``_kb``, key), so dynamic partition
    pruning reads only the key ranges the batch touches, and the remaining anti join
    is against that small matched set.
    """
    ckpt = checkpoint or table_path + "_checkpoint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(drop_dir)
    kb = F.floor(F.col(key) / bucket_width).cast("long")

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        others = [c for c in batch.columns if c != key]
        fresh = batch.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*").withColumn("_kb", kb)
        if table_exists(spark, table_path):
            stored = spark.read.parquet(table_path).select("_kb", key)
            seen = stored.join(fresh.select("_kb", key), ["_kb", key], "left_semi")
            fresh = fresh.join(seen, ["_kb", key], "left_anti")
        fresh.write.mode("append").partitionBy("_kb").parquet(table_path)

    q = (stream.writeStream.foreachBatch(upsert).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table_path


def run_log_stream(spark: SparkSession, src_dir: str, schema: StructType, out_path: str | None = None) -> str:
    """Action log: append each event with its JSON parameters parsed."""
    out_path = out_path or scratch_path(spark, "log_table")
    s = spark.readStream.schema(schema).parquet(src_dir)
    parsed = s.select("event_id", "user_id", F.col("event_type").alias("action"), "ts",
                      F.get_json_object("props", "$.k").cast("int").alias("k"),
                      F.to_json(F.struct(F.col("event_type").alias("action"), "value")).alias("parameters"))
    q = (parsed.writeStream.format("parquet").option("checkpointLocation", out_path + "_checkpoint")
         .option("path", out_path).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
