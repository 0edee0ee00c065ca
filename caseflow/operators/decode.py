"""Code → label decoding against the fixed code dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.rules.codes import code_rows


def code_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(code_rows(), "code_group string, code string, label string")


def decode_codes(spark: SparkSession, df: DataFrame, columns: list[str], key: str = "encounter_id",
                 group_of: dict[str, str] | None = None) -> DataFrame:
    """Long form (key, code_column, code, label) for the coded columns.

    The dimension is a fixed list of a few dozen rows (bounded by the code lists,
    not by the data), so broadcasting it is safe at any scale.
    """
    group_of = group_of or {}
    stacked = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("code_column"), F.lit(group_of.get(c, c)).alias("code_group"),
                 F.col(c).cast("string").alias("code")) for c in columns])).alias("u")).select(key, "u.*")
    dim = F.broadcast(code_dimension(spark))
    return (stacked.join(dim, ["code_group", "code"], "left")
            .select(key, "code_column", "code", "label"))
