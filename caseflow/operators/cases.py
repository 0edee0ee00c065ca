"""Case flagging, response parsing and the case-report build with its override rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import coding as cd
from caseflow.functions import fields as ff
from caseflow.functions import responses as rs
from caseflow.rules.vocab import CUTOFF_LOOKBACK_DAYS, DEFAULT_SCORE_CUTOFF, POSITIVE_COMPLAINTS

KEY = "encounter_id"

# Integer-coded case columns (coerced: anything not an integer becomes null).
INT_COLUMNS = ["injury_date", "injury_hour", "injury_min", "location", "area", "w4p", "no1", "bp1", "no2", "bp2",
               "no3", "bp3", "disp", "intent", "veh", "sub", "sd1", "sd2", "sd3", "sd4", "sd5", "sports_code"]
CASE_COLUMNS = [KEY, "intent", "sub", "sub_id", "i_o", "location", "area", "injury_date", "injury_hour",
                "injury_min", "am_pm", "sports_code", "sd1", "sd2", "sd3", "sd4", "sd5", "veh", "veh_p", "place",
                "w4p", "no1", "bp1", "no2", "bp2", "no3", "bp3", "disp"]


def positive_complaint(col: str = "chief_complaint") -> Column:
    return F.col(col).isin(POSITIVE_COMPLAINTS)


def dynamic_cutoff(encounters: DataFrame, batch_date, lookback_days: int = CUTOFF_LOOKBACK_DAYS,
                   default: float = DEFAULT_SCORE_CUTOFF) -> DataFrame:
    """One row: the lowest score among positive-complaint visits of the look-back window
    [batch_date - lookback, batch_date]; the configured default when there are none."""
    end = batch_date if isinstance(batch_date, dt.date) else dt.date.fromisoformat(str(batch_date))
    start = end - dt.timedelta(days=lookback_days)
    win = encounters.where((F.col("arrival_ts") >= F.lit(dt.datetime.combine(start, dt.time())))
                           & (F.col("arrival_ts") < F.lit(dt.datetime.combine(end + dt.timedelta(days=1), dt.time())))
                           & positive_complaint())
    return win.agg(F.coalesce(F.min("score"), F.lit(default)).alias("cutoff"))


def flag_cases(encounters: DataFrame, cutoff: Column) -> DataFrame:
    """``is_case``: score at or above the cutoff, or a complaint from the positive list."""
    return encounters.withColumn("is_case", F.coalesce(F.col("score") >= cutoff, F.lit(False)) | positive_complaint())


def raw_response(field: str) -> Column:
    """The response to one field, within an aggregate of (key, field, response) by key."""
    return F.max(F.when(F.col("field") == field, F.col("response")))


def responses_wide(responses: DataFrame) -> DataFrame:
    """(key, field, response) → one row per key and one raw column per field: a single
    hash aggregate with conditional picks (no pivot discovery pass)."""
    return responses.groupBy(KEY).agg(*[raw_response(f).alias(f"r_{f}") for f in rs.FIELDS])


def parse_responses(responses: DataFrame) -> DataFrame:
    """One row per key with the coded fields, worked out inside the aggregate: with a projection of its
    own above, Spark would leave a semi join with few keys there, and parse the answers of all visits."""
    r = {f: raw_response(f) for f in rs.FIELDS}
    sub, sub_id = rs.parse_substance(r["substance"])
    sd = rs.parse_safety(r["safety"])
    hour, minute = rs.parse_time(r["time"])
    return responses.groupBy(KEY).agg(
        rs.parse_summary(r["summary"]).alias("summary_text"),
        sub.alias("sub"), sub_id.alias("sub_id"),
        *[sd[k].alias(f"sd{k + 1}") for k in range(5)],
        rs.after_colon(r["io"]).alias("i_o"),
        rs.after_colon(r["sports"]).alias("sports_code"),
        hour.alias("injury_hour"), minute.alias("injury_min"),
        rs.parse_int_field(r["date"]).alias("injury_date"),
        rs.parse_zero_null(r["ampm"]).alias("am_pm"),
        rs.parse_zero_null(r["area"]).alias("area"),
        rs.parse_zero_null(r["location"]).alias("location"),
    )


def case_defaults(df: DataFrame) -> DataFrame:
    """Placeholder case columns so that non-cases keep a full row (all null, w4p = 0)."""
    cols = {c: F.lit(None).cast("string") for c in CASE_COLUMNS if c not in df.columns and c != KEY}
    cols["w4p"] = F.lit(0)
    return df.withColumns(cols)


def build_cases(flagged: DataFrame, parsed: DataFrame, encounters: DataFrame, remarks: DataFrame) -> DataFrame:
    """Case rows for flagged encounters: coded nature/body part, disposition code and the
    fixed override rules, applied in their order; version 1; integer columns coerced."""
    keys = flagged.where(F.col("is_case")).select(KEY)
    # Deferred work: answers and remarks are restricted to flagged visits first; the
    # semi join is pushed below their aggregations, so nothing is parsed for non-cases.
    base = (keys
            .join(encounters.select(KEY, "chief_complaint", "diagnosis", "disposition"), KEY, "inner")
            .join(parsed.join(keys, KEY, "left_semi"), KEY, "left")
            .join(remarks.join(keys, KEY, "left_semi"), KEY, "left"))
    base = case_defaults(base).withColumn("intent", F.col("intent").cast("string"))
    dx = F.lower(F.coalesce(F.col("diagnosis"), F.lit("none")))
    dx_sql = "lower(coalesce(diagnosis, 'none'))"
    base = cd.pin(base, _bp=cd.body_part(dx_sql))
    base = cd.pin(base, _nb=cd.nature_and_body(dx_sql, "_bp"))
    device = F.col("chief_complaint") == "Medical Device Problem"
    c = cd.pin(base, no1=F.when(device, F.lit(99)).otherwise(F.col("_nb.no")),
               bp1=F.when(device, F.lit(999)).otherwise(F.col("_nb.bp")))
    c = cd.pin(c, disp=cd.disposition_code(F.coalesce(F.col("remark"), F.lit("")), F.col("disposition"),
                                           F.col("no1"), F.col("bp1")))
    io = F.trim(F.col("i_o"))
    c = c.withColumn("i_o", F.when(io == "1", "I").when(io == "2", "O").otherwise(F.lit(None).cast("string")))
    ap = F.trim(F.col("am_pm"))
    hour = ff.int_or_null("injury_hour")  # more reliable than the am/pm answer, which it overrides
    c = c.withColumn("am_pm", F.when((hour >= 0) & (hour < 12), "a").when((hour >= 12) & (hour <= 23), "p")
                     .when(ap == "1", "a").when(ap == "2", "p").otherwise(F.col("am_pm")))
    mins = F.regexp_replace(F.col("injury_min"), r"\.", "")
    c = c.withColumn("injury_min", F.when(mins != "", mins))
    c = c.withColumn("injury_date", ff.int_or_null("injury_date").cast("string"))
    s = F.coalesce(F.col("summary_text"), F.lit(""))
    c = c.withColumn("area", F.when(s.contains("monkey bar"), F.lit("59")).otherwise(F.col("area")))
    for word, val in (("laminate floor", "I"), ("snow", "O"), ("washroom", "I"), ("bathroom", "O")):
        c = c.withColumn("i_o", F.when(s.contains(word), F.lit(val)).otherwise(F.col("i_o")))
    c = c.withColumn("i_o", F.when(F.lower(s) == "pulled elbow", F.lit("3")).otherwise(F.col("i_o")))
    c = c.withColumn("i_o", F.when(F.col("no1") == 71, F.lit("16")).otherwise(F.col("i_o")))
    skull = (F.col("no1") == 12) & (F.col("bp1") == 110)
    c = (c.withColumn("no2", F.when(skull, F.lit("41")).otherwise(F.col("no2")))
          .withColumn("bp2", F.when(skull, F.lit("135")).otherwise(F.col("bp2"))))
    left = F.col("disp") == 1
    c = (c.withColumn("bp1", F.when(left, F.lit(999)).otherwise(F.col("bp1")))
          .withColumn("no1", F.when(left, F.lit(99)).otherwise(F.col("no1"))))
    c = c.withColumn("intent", F.when(F.col("no1") == 71, F.lit("16")).otherwise(F.col("intent")))
    mont = dx.contains("monteggia")
    c = (c.withColumn("no2", F.when(mont, F.lit("13")).otherwise(F.col("no2")))
          .withColumn("bp2", F.when(mont, F.lit("430")).otherwise(F.col("bp2"))))
    c = c.withColumn("i_o", F.when(F.col("i_o") == "16", F.lit(None)).otherwise(F.col("i_o")))
    out = c.select(*CASE_COLUMNS).withColumn("version", F.lit(1))
    return coerce_codes(out)


def coerce_codes(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: ff.int_or_null(c) for c in (cols or INT_COLUMNS) if c in df.columns})
