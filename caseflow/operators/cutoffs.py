"""Automatic result cutoffs over a ranked, already top-k-limited result.

Both run a window without partitioning: they are applied only after ``limit(k)``,
so the single window task holds at most k rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.sources.sinks import roundtrip


def _ranked(df: DataFrame, score: str, tie: str) -> tuple[DataFrame, Window]:
    w = Window.orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("_pos", F.row_number().over(w) - 1), w


def cumulative_mass(df: DataFrame, score: str, tie: str, mass: float = 0.95, inclusive: bool = True,
                    bypass_below: int = 0) -> DataFrame:
    """Keep the head of the descending ranking whose running share of the total stays
    within ``mass``: up to and including the cut row (search), or strictly before it
    (rerank, ``inclusive=False``). An empty head keeps the first row; an all-zero total
    keeps everything. With ``bypass_below``, a ranking shorter than that is kept whole
    (decided in the same window pass, so the input is evaluated once)."""
    r, w = _ranked(df, score, tie)
    whole = Window.partitionBy()
    r = (r.withColumn("_cum", F.sum(score).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
          .withColumn("_tot", F.sum(score).over(whole))
          .withColumn("_cnt", F.count(F.lit(1)).over(whole)))
    r = r.withColumn("_in", F.when(F.col("_tot") == 0, F.lit(0)).otherwise(
        (F.col("_cum") / F.col("_tot") <= mass).cast("int")))
    r = r.withColumn("_idx", F.sum("_in").over(whole) - 1)
    if inclusive:
        keep = (F.col("_tot") == 0) | (F.col("_pos") <= F.greatest(F.col("_idx"), F.lit(0)))
    else:
        keep = (F.col("_tot") == 0) | (F.col("_pos") < F.greatest(F.col("_idx"), F.lit(1)))
    keep = keep | (F.col("_cnt") < bypass_below)
    return r.where(keep).drop("_pos", "_cum", "_tot", "_in", "_idx", "_cnt")


def knee(df: DataFrame, score: str, tie: str, bypass_below: int = 0) -> DataFrame:
    """Keep the head up to the knee: min-max normalise the descending scores, subtract
    the chord from first to last point, cut at the (first) largest signed gap."""
    r, w = _ranked(df, score, tie)
    whole = Window.partitionBy()
    r = (r.withColumn("_n", F.count(F.lit(1)).over(whole))
          .withColumn("_lo", F.min(score).over(whole))
          .withColumn("_hi", F.max(score).over(whole)))
    r = r.withColumn("_sn", (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-12)))
    r = (r.withColumn("_first", F.first("_sn").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
          .withColumn("_last", F.last("_sn").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    x = F.when(F.col("_n") > 1, F.col("_pos") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    r = r.withColumn("_gap", F.col("_sn") - (F.col("_first") + (F.col("_last") - F.col("_first")) * x))
    r = r.withColumn("_idx", F.min_by("_pos", F.struct(-F.col("_gap"), F.col("_pos"))).over(whole))
    keep = (F.col("_pos") <= F.col("_idx")) | (F.col("_n") < bypass_below)
    return r.where(keep).drop("_pos", "_n", "_lo", "_hi", "_sn", "_first", "_last", "_gap", "_idx")


def choose(method: str = "cum_mass", **kwargs):
    """The cutoff strategy by name, with bound keyword arguments."""
    if method == "elbow":
        return partial(knee, **kwargs)
    if method == "cum_mass":
        return partial(cumulative_mass, **kwargs)
    raise ValueError(f"unknown cutoff method {method!r}")


def unbounded(cutoff):
    """The form of a cutoff for inputs of any size, with the same bound arguments."""
    fn, kw = (cutoff.func, cutoff.keywords) if isinstance(cutoff, partial) else (cutoff, {})
    forms = {cumulative_mass: cumulative_mass_global, knee: knee_global}
    return partial(forms[fn], **{k: v for k, v in kw.items() if k != "bypass_below"})


# ---------------------------------------------------------------- unbounded inputs
def global_rank(df: DataFrame, score: str, tie: str, with_running_sum: bool = False,
                partitions: int | None = None) -> DataFrame:
    """0-based position in the (score desc, tie asc) order, optionally with the running
    sum of ``score``, for inputs of any size.

    The rows are range-partitioned on the sort key (sampled bounds, so a hot score
    value or key is split like any other range) and written to the shared folder with
    their partition number: the bounds are sampled once, so offsets and rows agree. Each
    partition's count and sum are aggregated, turned into offsets over the partitions (one
    row per partition, bounded by the partition count, so it is broadcast), and added to
    the positions and running sums computed inside each partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(score).desc(), F.col(tie).asc()]
    ranged = roundtrip(df.sparkSession, df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()),
                       "ranked")
    aggs = [F.count(F.lit(1)).alias("_pc")] + ([F.sum(score).alias("_ps")] if with_running_sum else [])
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = ranged.groupBy("_pid").agg(*aggs).select(
        "_pid", F.coalesce(F.sum("_pc").over(prior), F.lit(0)).alias("_off_n"),
        *([F.coalesce(F.sum("_ps").over(prior), F.lit(0.0)).alias("_off_s")] if with_running_sum else []))
    local = Window.partitionBy("_pid").orderBy(*order)
    out = ranged.withColumn("_lpos", F.row_number().over(local) - 1)
    if with_running_sum:
        out = out.withColumn("_lcum", F.sum(score).over(local.rowsBetween(Window.unboundedPreceding,
                                                                          Window.currentRow)))
    out = out.join(F.broadcast(offs), "_pid").withColumn("_pos", F.col("_off_n") + F.col("_lpos"))
    if with_running_sum:
        out = out.withColumn("_cum", F.col("_off_s") + F.col("_lcum"))
    return out.drop("_pid", "_lpos", "_lcum", "_off_n", "_off_s")


def cumulative_mass_global(df: DataFrame, score: str, tie: str, mass: float = 0.95,
                           inclusive: bool = True) -> DataFrame:
    """``cumulative_mass`` for unbounded inputs (no single-task window)."""
    total = df.agg(F.sum(score)).scalar()
    r = global_rank(df, score, tie, with_running_sum=True)
    within = F.when(total == 0, F.lit(False)).otherwise(F.col("_cum") / total <= mass)
    idx = r.agg(F.sum(within.cast("int")) - 1).scalar()
    keep = F.col("_pos") <= F.greatest(idx, F.lit(0)) if inclusive else F.col("_pos") < F.greatest(idx, F.lit(1))
    return r.where((total == 0) | keep).drop("_pos", "_cum")


def knee_global(df: DataFrame, score: str, tie: str) -> DataFrame:
    """``knee`` for unbounded inputs: global min/max/count and the arg-max of the gap are
    aggregates; positions come from ``global_rank``."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    n, lo, hi = (stats.select(c).scalar() for c in ("n", "lo", "hi"))
    r = global_rank(df, score, tie)
    sn = (F.col(score) - lo) / (hi - lo + F.lit(1e-12))
    first = (hi - lo) / (hi - lo + F.lit(1e-12))
    x = F.when(n > 1, F.col("_pos") / (n - 1)).otherwise(F.lit(0.0))
    gap = sn - (first + (F.lit(0.0) - first) * x)
    idx = r.agg(F.min_by("_pos", F.struct(-gap, F.col("_pos")))).scalar()
    return r.where(F.col("_pos") <= idx).drop("_pos")
