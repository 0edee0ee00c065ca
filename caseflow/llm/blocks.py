"""Documents in blocks, and an exchange between blocks and key partitions.

Several corpus operators have the same shape: a document can be judged only after its
pieces (windows, n-grams, words) have met the same pieces of all other documents. Moving
one row per piece would move many times the corpus, so the pieces travel packed:

* ``Blocks`` writes the texts once, dealt by a hash of document key and text into blocks of
  a few MB, as a table bucketed by block, in the shared folder. Every later step over blocks
  reads it without a shuffle. Different texts under one key (or under null) lie in many blocks.
* ``ask`` lets every block send, per key partition, one packed batch of its *distinct*
  pieces: copies inside a block collapse before the shuffle, so a piece that a third of
  all rows hold arrives once per block, not once per row.
* ``answer`` sees all batches of one key partition together and sends each block its reply.
* ``settle`` brings a block's texts and its replies together again.

A packed batch is an Arrow batch in compressed IPC form. Work and memory of one task are
bounded by the block and part sizes, which do not depend on the size of the corpus. All
steps are ordinary shuffles and a written table, so lost executors only cost a re-run.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.session import scratch_path

BLOCK_BYTES = 4 << 20
TIGHT = 6  # compression of texts, which are written twice and read often
NULL_KEY = 1 - (1 << 63)  # a missing document key sorts before every other; it can be negated


def pack(level: int = 1, **columns) -> bytes:
    """Arrays of one length → compressed bytes."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))
    batch = pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()],
                            names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def bodies(table: pa.Table):
    """The packed batches in the ``body`` column of a table."""
    for chunk in table.column("body").chunks:
        for v in chunk:
            yield unpack(v.as_buffer())


def numpy_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def split_by_part(part: np.ndarray, n_parts: int):
    """Row numbers grouped by part: yields (part, row numbers)."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p]:bounds[p + 1]]


def release(spark) -> None:
    """Let go of shuffle files of finished steps now rather than at the next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder, which cuts the lineage. Its path is
    added to ``scratch``, for ``discard`` once nothing reads it any more."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, name: str, scratch: list[str], buckets: int = 0, to: str | None = None) -> tuple[str, DataFrame]:
    """The rows of ``df`` as a table bucketed and sorted by ``by``, whose files lie in the shared folder:
    its name, for ``DROP TABLE``, and its rows. Joins and groups on ``by`` read it without a shuffle.
    Given the table ``to``, of the same buckets, they are added to it."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(buckets, by).write.option("compression", "uncompressed").bucketBy(buckets, by).sortBy(by)
    if to:
        out.mode("append").saveAsTable(to)
        return to, spark.table(to)
    path, table = scratch_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    scratch.append(path)
    out.option("path", path).saveAsTable(table)
    return table, spark.table(table)


def discard(spark, scratch: list[str]) -> None:
    """Delete the written tables listed in ``scratch``, and let go of finished shuffles."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while scratch:
        path = hadoop.Path(scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def give_back() -> None:
    """Return freed memory to the system between blocks: workers live on while the executor's
    own heap grows in later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Text:
    """The texts of one block as one byte buffer: row ``i`` is ``buf[off[i]:off[i + 1]]``.

    Rows are in a fixed order (key, then text), so row numbers mean the same in every
    step. ``ids`` holds the keys with ``NULL_KEY`` for null; a null text is empty and
    False in ``valid``.
    """

    def __init__(self, table: pa.Table):
        parts = list(bodies(table))
        rows = pa.concat_tables(parts).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = rows.column("text")
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.large_binary())
        self.valid = np.asarray(text.is_valid())
        text = text.fill_null(b"")
        self.keys = rows.column("doc_id")
        self.ids = self.keys.fill_null(NULL_KEY).to_numpy()
        _, offsets, data = text.buffers()
        self.off = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
        self.buf = (np.frombuffer(data, np.uint8)[self.off[0]:self.off[-1]]
                    if data is not None and len(text) else np.zeros(0, np.uint8))
        self.off = self.off - self.off[0]
        self.n = len(text)

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.off[i]:self.off[i + 1]].tobytes()


class Blocks:
    """The texts of ``docs`` (doc_id, text) dealt into blocks; see the module text.

    The table lives in the shared folder until ``drop``. Columns other than doc_id and text
    are not kept; repeated, null and empty rows are.
    """

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        spark = self.spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").cast("binary").alias("text"))
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.n_blocks = n = max(buckets, -(-total // block_bytes))
        self.n_parts = max(buckets, n // 2)

        def deal(batches):
            for b in batches:
                for block, at in split_by_part(b.column("block").to_numpy(zero_copy_only=False), n):
                    some = b.take(pa.array(at))
                    body = pack(TIGHT, doc_id=some.column("doc_id"), text=some.column("text").cast(pa.large_binary()))
                    yield pa.record_batch([pa.array([block], pa.int32()), pa.array([body], pa.binary())],
                                          names=["block", "body"])

        dealt = (rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
                 .mapInArrow(deal, "block int, body binary"))
        self._scratch: list[str] = []
        self.table, self.df = bucketed(dealt, "block", "blocks", self._scratch, buckets)
        del dealt
        release(spark)

    def ask(self, fn) -> DataFrame:
        """fn(Text, block) yields (part, packed bytes)."""
        def run(key, table):
            block = key[0].as_py()
            out = _rows(list(fn(Text(table), block)), block)
            give_back()
            return out
        return self.df.groupBy("block").applyInArrow(run, "part int, block int, body binary")

    def ask_again(self, replies: DataFrame, fn) -> DataFrame:
        """fn(Text, replies, block) yields (part, packed bytes)."""
        def run(key, left, right):
            block = key[0].as_py()
            out = _rows(list(fn(Text(left), list(bodies(right)), block)) if left.num_rows else [], block)
            give_back()
            return out
        return (self.df.groupBy("block").cogroup(replies.groupBy("block"))
                .applyInArrow(run, "part int, block int, body binary"))

    def settle(self, replies: DataFrame, fn, schema: str) -> DataFrame:
        """fn(Text, replies) returns a table of ``schema``: the last step over a block."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType
        arrow = to_arrow_schema(StructType.fromDDL(schema))

        def run(key, left, right):
            if not left.num_rows:
                return arrow.empty_table()
            out = pa.table(fn(Text(left), list(bodies(right))), schema=arrow)
            give_back()
            return out
        return self.df.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.spark, self._scratch)


def _rows(sent: list, block: int) -> pa.Table:
    return pa.table({"part": pa.array([p for p, _ in sent], pa.int32()),
                     "block": pa.array([block] * len(sent), pa.int32()),
                     "body": pa.array([b for _, b in sent], pa.binary())})


def answer(requests: DataFrame, fn) -> DataFrame:
    """fn([(block, Table)]) yields (block, packed bytes), over all batches of one part."""
    def run(table):
        got = list(zip(table.column("block").to_pylist(), bodies(table)))
        sent = list(fn(got))
        give_back()
        return pa.table({"block": pa.array([b for b, _ in sent], pa.int32()),
                         "body": pa.array([x for _, x in sent], pa.binary())})
    return requests.groupBy("part").applyInArrow(run, "block int, body binary")
