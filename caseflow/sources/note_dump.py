"""Readers for delimited note dumps and headered exports.

A dump is a set of text files; each file starts with a header line. Lines are read
in parallel by ``spark.read.text``; the header is recognised by its key column
(it may occur once per file), never by line order, so files split across tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import fields as ff


def _clean(line):
    """Drop non-ASCII characters, then surrounding whitespace."""
    return F.regexp_replace(F.regexp_replace(line, r"[^\x00-\x7F]", ""), r"^\s+|\s+$", "")


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first ``n`` lines of the first file (file listing is metadata; only the
    start of one file is read)."""
    files = sorted(spark.read.text(path).inputFiles())
    for f in files:  # skip empty files (a writer may leave some)
        lines = [r["value"] for r in spark.read.text(f).limit(n).collect()]
        if lines:
            return lines
    raise ValueError(f"no input lines under {path}")


def read_note_dump(spark: SparkSession, path: str, key_column: str, delim: str = "|",
                   mode: str = "permissive", header: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). A row with more fields than the header joins the surplus with a
    blank into the last column; a row with fewer fields is rejected, or raises when
    ``mode='strict'``. All columns are strings (typing is a separate step).

    The header is given, or taken from the first line of the first file; header lines
    repeated in other files are recognised by their key column and dropped."""
    lines = spark.read.text(path).select(_clean(F.col("value")).alias("line"))
    sep = re.escape(delim)
    fields = F.split(F.col("line"), sep, -1)
    if header is None:
        first = [ln.strip() for ln in _first_lines(spark, path, 1)]
        if not first or first[0].split(delim)[0] != key_column:
            raise ValueError(f"the first line is not a header starting with {key_column!r}")
        header = first[0].split(delim)
    n = len(header)
    body = lines.where((F.get(fields, 0) != key_column) & (F.length("line") > 0)).withColumn("_f", fields)
    rejects = body.where(F.size("_f") < n).select("line")
    if mode == "strict" and not rejects.isEmpty():
        raise ValueError(f"rows with fewer than {n} fields in {path}")
    good = body.where(F.size("_f") >= n)
    last = F.array_join(F.slice(F.col("_f"), n, F.greatest(F.size("_f") - n + 1, F.lit(1))), " ")
    cols = [F.get(F.col("_f"), i).alias(header[i]) for i in range(n - 1)] + [last.alias(header[n - 1])]
    return good.select(*cols), rejects


def read_headered_export(spark: SparkSession, path: str, key_column: str,
                         delim: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of an export whose header is on the first or the second line (a
    title line may come first). The header is the line holding the key column; a missing
    key column is an error. Fields may be quoted (``"a, b"``, doubled quotes inside); a row
    whose field count differs from the header's is a reject, so rows and rejects together
    are all lines but titles, headers and blank lines."""
    first = _first_lines(spark, path, 2)
    at = [i for i, ln in enumerate(first) if key_column in ln.split(delim)]
    if not at:
        raise ValueError(f"{key_column!r} column not found")
    header = first[at[0]].split(delim)
    titles = first[:at[0]]
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    fields = F.split(F.col("line"), re.escape(delim), -1)
    lines = lines.where(~F.array_contains(fields, key_column) & ~F.col("line").isin(titles))
    names = [f"_f{i}" for i in range(len(header))]
    schema = ", ".join(f"{n} string" for n in names) + ", _bad string"
    options = {"sep": delim, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select("line", F.from_csv("line", schema, options).alias("_r"))
    good = parsed.where("_r._bad IS NULL")
    return (good.select(*[F.col(f"_r.{n}").alias(h) for n, h in zip(names, header)]),
            parsed.where("_r._bad IS NOT NULL").select("line"))


FORMATS = {".txt": "dump", ".dat": "dump", ".csv": "export", ".parquet": "parquet"}


def read_notes(spark: SparkSession, path: str, key_column: str, format: str | None = None,
               delim: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of note input in any format: "dump", "export" or "parquet", stated or told by the
    extension of ``path`` (that of a file, a folder or a pattern). All columns are strings, as in the
    other readers; parquet has no rejects. An unknown format, or input without the key column, is
    an error."""
    kind = format or next((f for ext, f in FORMATS.items() if path.rstrip("/").lower().endswith(ext)), None)
    if kind == "dump":
        return read_note_dump(spark, path, key_column, delim or "|")
    if kind == "export":
        return read_headered_export(spark, path, key_column, delim or ",")
    if kind != "parquet":
        raise ValueError(f"no reader for {path!r}; state one of {sorted(set(FORMATS.values()))}")
    rows = spark.read.parquet(path)
    if key_column not in rows.columns:
        raise ValueError(f"{key_column!r} column not found")
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]), spark.createDataFrame([], "line string")


# Timestamp forms met in exports, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss",
                "yyyy/MM/dd", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "d-MMM-yyyy HH:mm", "d-MMM-yyyy"]


def mixed_timestamp(c: str):
    """The first of ``DATE_FORMATS`` that reads the cell; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(F.col(c)), F.lit(f)) for f in DATE_FORMATS])


def type_note_lines(df: DataFrame) -> DataFrame:
    """Typed columns: LOS hours from arrival/departure, arrival time of day, integer
    keys, blank triage level → 0. Dates may come in any of ``DATE_FORMATS``; a cell that
    cannot be read is null and never ends the job."""
    arr, dep = mixed_timestamp("arrival_datetime"), mixed_timestamp("departure_datetime")
    ctas = F.trim(F.col("ctas"))
    return df.select(
        ff.whole_number("encounter_id", "long").alias("encounter_id"),
        ff.whole_number("subject_id", "long").alias("subject_id"),
        arr.alias("arrival_ts"),
        ((F.unix_timestamp(dep) - F.unix_timestamp(arr)) / 3600.0).alias("los"),
        F.date_format(arr, "HH:mm:ss").alias("arrival_time"),
        F.when(ctas == "", F.lit(0)).otherwise(ff.int_or_null(ctas)).alias("ctas"),
    )
