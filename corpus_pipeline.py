"""The training-corpus pipeline: documents in, token ids out.

Stages, each written as Parquet and read again by the next:

1. ``language_id``    documents without a recognisable language go: null, no letters, or a score below
                      the ``least_score`` that practically all labelled documents reach; the model
                      and that score come from all labelled texts, whole
2. ``exact_dedup``    of texts equal but for the case of A-Z, the largest doc_id stays
3. ``near_dedup``     of documents linked by 5-word shingles at similarity 0.8, one stays
4. ``decontaminate``  documents that hold a benchmark window of 10 words go
5. ``sentencepiece``  the remaining texts as piece ids

Every stage but the last returns the columns of ``documents``. No SQL gives the rows of the
language model, so ``ORACLE_SQL`` is None; the tests hold the stages against brute force.

Rows that repeat a doc_id share the verdict on their text; null texts go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm.decontaminate import drop_documents
from caseflow.llm.language_id import keep_recognised, train
from caseflow.llm.partenum import keep_one
from caseflow.llm.radix_dedup import keep_largest
from caseflow.llm.sentencepiece import encode
from caseflow.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = train(docs.select("doc_id", "text", "lang"))
    return keep_recognised(docs, net, net.least_score if net else 0.0)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_largest(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
