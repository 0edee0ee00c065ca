"""Stand-in roles over the driver tables.

The engine's own tables (subjects, encounters, note lines, notes, summaries,
case reports ...) do not exist in the driver data, so each role is derived from
one driver table by plain column expressions (see FIXTURES.md part B). Each role
has a Spark builder and the same derivation as DuckDB SQL text, so that oracle
queries can start from the identical input. Only the derivation is shared: every
operator is written separately on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import prepare

# Fixture vocabulary: chief complaints cycled over encounters (mix of listed
# positive complaints and others), indexed by encounter_id % 8.
FIXTURE_COMPLAINTS = ["Head Injury", "Abdominal Pain", "Upper Extremity Injury", "Fever",
                      "Medical Device Problem", "Burn", "Cough", "Laceration/Puncture"]

# Fixture diagnosis texts, indexed by (encounter_id * 13) % len. Each line names
# the rule it exercises; tests/test_coding.py holds the hand-worked codes.
FIXTURE_DIAGNOSES = [
    "Fracture of metatarsal bone",            # foot
    "Minor head injury",                      # head, nature 41
    "Laceration of eyelid",                   # face, open wound
    "Abrasion of forearm",                    # superficial, forearm
    "Sprain of ankle",                        # ankle
    "Closed fracture of distal radius",       # wrist by distal radius
    "Concussion",                             # 42
    "Foreign body in ear",                    # 32
    "Foreign body in nose",                   # 33
    "Dog bite of hand",                       # bite, hand
    "Burn of hand",                           # burn
    "Subungual hematoma of finger",           # pre-step then bruise chain
    "Facial fracture",                        # 42/135 pre-step then fracture chain
    "Pulled elbow",                           # 75 / 430
    "Overdose",                               # 50 / 900
    "Depression",                             # 71 / 900
    "Dislocation of shoulder",                # 13 / 410
    "Contusion of knee",                      # 10 / 530
    "Fracture of clavicle",                   # 12 / 415
    "Crush injury of toe",                    # 18 / 570
    "Corneal abrasion of eye",                # 24 / 135
    "Dental injury",                          # 25 / 135
    "Splinter in skin",                       # 37
    "Near drowning",                          # 51
    "Choking episode",                        # 52 (or FB airway chain)
    "Abdominal pain",                         # 27 / 321
    "Viral infection",                        # nothing
    "No injury, infection ruled out",         # 70
    "Stab wound to chest",                    # 77 / 310
    "Fracture of tibia and fibula",           # tibia+fibula rule
    "Monteggia fracture of forearm",          # 12 + monteggia override
    "Nursemaid elbow",                        # 75
    "Head trauma",                            # 41
    "Subdural hematoma",                      # 43
    "Fracture of skull",                      # pre-step 42/135 then fracture 12/110
    "Open wound of scalp",                    # 11 / 110
    "Strain of lower back",                   # 14 / 322
    "Amputation of thumb",                    # 19 / 470
    "Electric shock",                         # 23
    "Injury of spleen",                       # 26
    None,                                     # null diagnosis
]

FIXTURE_CITIES = ["Ottawa", "Kingston", "Toronto"]
FIXTURE_DISPOSITIONS = {"F": "Admit", "O": "Discharge", "P": "LWBS"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, idx: Column) -> Column:
    """values[idx] with a 0-based index column (values is a small fixed list)."""
    arr = F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values])
    return F.get(arr, idx.cast("int"))


def _sql_list(values: list) -> str:
    parts = ["NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values]
    return "[" + ", ".join(parts) + "]"


# ---------------------------------------------------------------- subjects
def subjects_src(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(
        (F.col("c_custkey") + 100000).alias("subject_id"),
        F.col("c_name").alias("subject_name"),
        F.date_add(F.lit("1980-01-01").cast("date"), ((F.col("c_custkey") * 37) % 7000).cast("int")).alias("dob"),
    )


SUBJECTS_SQL = """SELECT c_custkey + 100000 AS subject_id, c_name AS subject_name,
  DATE '1980-01-01' + CAST((c_custkey * 37) % 7000 AS INTEGER) AS dob FROM customer"""


# ---------------------------------------------------------------- visits (one row per encounter)
def visits_src(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    disp = F.col("o_orderstatus")
    return o.select(
        k.alias("encounter_id"),
        (F.col("o_custkey") + 100000).alias("subject_id"),
        F.col("o_orderdate").alias("arrival_ts"),
        F.col("o_orderdate").cast("date").alias("arrival_date"),
        F.when(F.col("o_custkey") % 3 == 0, "male").when(F.col("o_custkey") % 3 == 1, "female")
         .otherwise("X").alias("sex_raw"),
        F.substring("o_orderpriority", 1, 1).alias("ctas_raw"),
        _pick(FIXTURE_COMPLAINTS, k % len(FIXTURE_COMPLAINTS)).alias("chief_complaint"),
        _pick(FIXTURE_DIAGNOSES, (k * 13) % len(FIXTURE_DIAGNOSES)).alias("diagnosis"),
        F.when(disp == "F", "Admit").when(disp == "O", "Discharge").otherwise("LWBS").alias("disposition"),
        (((k * 7919) % 1000) / 1000.0).alias("score"),
        (((k * 31) % 240) / 10.0).alias("los"),
        F.when(F.col("o_custkey") % 4 == 0, "K1A 0B1").when(F.col("o_custkey") % 4 == 1, "M5V2T6")
         .when(F.col("o_custkey") % 4 == 2, "H2X 1Y4").alias("postal_code"),
        F.concat((F.col("o_custkey") % 900 + 1).cast("string"), F.lit(" Main Street")).alias("address"),
        _pick(FIXTURE_CITIES, F.col("o_custkey") % len(FIXTURE_CITIES)).alias("city"),
        F.lit("ON").alias("province"),
    )


VISITS_SQL = f"""SELECT o_orderkey AS encounter_id, o_custkey + 100000 AS subject_id,
  o_orderdate AS arrival_ts, CAST(o_orderdate AS DATE) AS arrival_date,
  CASE WHEN o_custkey % 3 = 0 THEN 'male' WHEN o_custkey % 3 = 1 THEN 'female' ELSE 'X' END AS sex_raw,
  substr(o_orderpriority, 1, 1) AS ctas_raw,
  ({_sql_list(FIXTURE_COMPLAINTS)})[CAST(o_orderkey % {len(FIXTURE_COMPLAINTS)} AS INTEGER) + 1] AS chief_complaint,
  ({_sql_list(FIXTURE_DIAGNOSES)})[CAST((o_orderkey * 13) % {len(FIXTURE_DIAGNOSES)} AS INTEGER) + 1] AS diagnosis,
  CASE o_orderstatus WHEN 'F' THEN 'Admit' WHEN 'O' THEN 'Discharge' ELSE 'LWBS' END AS disposition,
  CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0 AS score,
  CAST((o_orderkey * 31) % 240 AS DOUBLE) / 10.0 AS los,
  CASE WHEN o_custkey % 4 = 0 THEN 'K1A 0B1' WHEN o_custkey % 4 = 1 THEN 'M5V2T6'
       WHEN o_custkey % 4 = 2 THEN 'H2X 1Y4' END AS postal_code,
  CAST(o_custkey % 900 + 1 AS VARCHAR) || ' Main Street' AS address,
  ({_sql_list(FIXTURE_CITIES)})[CAST(o_custkey % {len(FIXTURE_CITIES)} AS INTEGER) + 1] AS city, 'ON' AS province
FROM orders"""


# ---------------------------------------------------------------- note lines (conversations)
def note_lines_src(spark, d) -> DataFrame:
    c = read(spark, d, "conversations")
    role = F.col("role")
    return c.select(
        F.col("conv_id").alias("encounter_id"),
        (F.col("conv_id") * 10 + F.when(role == "user", 1).when(role == "assistant", 2).otherwise(3))
        .alias("note_id"),
        F.when(role == "user", "ED Triage Notes").when(role == "assistant", "ED Provider Notes")
         .otherwise("Consults").alias("note_type"),
        F.col("role").alias("author_type"),
        F.lit("Emergency").alias("author_service"),
        (F.col("turn") + 1).cast("int").alias("line"),
        F.col("text").alias("note_text"),
    )


NOTE_LINES_SQL = """SELECT conv_id AS encounter_id,
  conv_id * 10 + CASE WHEN role = 'user' THEN 1 WHEN role = 'assistant' THEN 2 ELSE 3 END AS note_id,
  CASE WHEN role = 'user' THEN 'ED Triage Notes' WHEN role = 'assistant' THEN 'ED Provider Notes'
       ELSE 'Consults' END AS note_type,
  role AS author_type, 'Emergency' AS author_service,
  CAST(turn + 1 AS INTEGER) AS line, text AS note_text
FROM conversations"""


# ---------------------------------------------------------------- notes (documents)
def notes_src(spark, d) -> DataFrame:
    doc = read(spark, d, "documents")
    lang = F.col("lang")
    return doc.select(
        F.col("doc_id").alias("note_id"),
        F.col("doc_id").alias("encounter_id"),
        F.when(lang == "en", "ED Provider Notes").when(lang == "fr", "ED Triage Notes")
         .when(lang == "de", "Consults").otherwise("Progress Notes").alias("note_type"),
        F.col("lang").alias("author_type"),
        F.col("source").alias("author_service"),
        F.col("text").alias("note_text"),
    )


NOTES_SQL = """SELECT doc_id AS note_id, doc_id AS encounter_id,
  CASE WHEN lang = 'en' THEN 'ED Provider Notes' WHEN lang = 'fr' THEN 'ED Triage Notes'
       WHEN lang = 'de' THEN 'Consults' ELSE 'Progress Notes' END AS note_type,
  lang AS author_type, source AS author_service, text AS note_text
FROM documents"""


# ---------------------------------------------------------------- summaries (documents; every third has two versions)
def summaries_src(spark, d) -> DataFrame:
    doc = read(spark, d, "documents")
    version = F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return doc.select(F.col("doc_id").alias("encounter_id"), "text", version.alias("version")).select(
        "encounter_id", F.when(F.col("version") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" thon revised")))
        .alias("summary_text"), "version")


SUMMARIES_SQL = """SELECT doc_id AS encounter_id, text AS summary_text, 1 AS version FROM documents
UNION ALL SELECT doc_id, text || ' thon revised', 2 FROM documents WHERE doc_id % 3 = 0"""
LATEST_SUMMARIES_SQL = """SELECT doc_id AS encounter_id,
  CASE WHEN doc_id % 3 = 0 THEN text || ' thon revised' ELSE text END AS summary_text,
  CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents"""


# ---------------------------------------------------------------- problems / referrals (lineitem)
def problems_src(spark, d) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = read(spark, d, "part").select("p_partkey", "p_name")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select(F.col("l_orderkey").alias("encounter_id"), F.col("p_name").alias("problem")))


PROBLEMS_SQL = """SELECT l_orderkey AS encounter_id, p_name AS problem
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def referrals_src(spark, d) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s = read(spark, d, "supplier").select("s_suppkey", "s_name")
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .select(F.col("l_orderkey").alias("encounter_id"), F.col("s_name").alias("referral")))


REFERRALS_SQL = """SELECT l_orderkey AS encounter_id, s_name AS referral
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


# ---------------------------------------------------------------- case report versions (lineitem)
INTENT_CODES = [10, 11, 12, 13, 15, 16, 19]
NATURE_CODES = [10, 11, 12, 13, 14, 27, 41, 42, 50, 71]
BODY_CODES = [110, 120, 310, 410, 440, 450, 460, 530, 550, 900]
SD_CODES = [-1, 0, 2, 3, 6, 9]
LOCATION_CODES = [11, 12, 42, 62, 64, 82, 131, 7777]  # the last has no label
AREA_CODES = [11, 16, 42, 59, 72, 84, 92]


def case_rows_src(spark, d) -> DataFrame:
    """The line behind each stored version: one per (order, line number); of several lines with one
    number, the smallest by part and supplier (an aggregate with map-side combine, no sort per order)."""
    li = read(spark, d, "lineitem")
    row = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_tax")
    return (li.groupBy("l_orderkey", "l_linenumber").agg(F.min(row).alias("_r"))
            .select("l_orderkey", "l_linenumber", "_r.*"))


def case_keys_src(spark, d) -> DataFrame:
    """The visits that have a stored version, repeats included."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("encounter_id"))


def case_versions_src(spark, d) -> DataFrame:
    return case_columns(case_rows_src(spark, d))


def case_columns(li: DataFrame) -> DataFrame:
    """The stored version of each of the lines ``li``, all columns."""
    q = F.col("l_quantity").cast("long")
    return li.select(
        F.col("l_orderkey").alias("encounter_id"),
        F.col("l_linenumber").cast("int").alias("version"),
        _pick(INTENT_CODES, F.col("l_linenumber") % len(INTENT_CODES)).cast("int").alias("intent"),
        _pick(NATURE_CODES, q % len(NATURE_CODES)).cast("int").alias("no1"),
        _pick(BODY_CODES, F.col("l_partkey") % len(BODY_CODES)).cast("int").alias("bp1"),
        _pick(SD_CODES, F.col("l_suppkey") % len(SD_CODES)).cast("int").alias("sd1"),
        _pick(SD_CODES, (F.col("l_suppkey") + q) % len(SD_CODES)).cast("int").alias("sd2"),
        F.when(F.col("l_linestatus") == "O", "I").otherwise("O").alias("i_o"),
        (F.col("l_suppkey") % 9 + 1).cast("int").alias("disp"),
        (19980000 + (F.col("l_partkey") % 12 + 1) * 100 + F.col("l_suppkey") % 28 + 1).cast("int").alias("injury_date"),
        (q % 24).cast("int").alias("injury_hour"),
        (F.col("l_partkey") % 60).cast("int").alias("injury_min"),
        F.when(q % 24 < 12, "a").otherwise("p").alias("am_pm"),
        _pick(LOCATION_CODES, F.col("l_partkey") % len(LOCATION_CODES)).cast("int").alias("location"),
        _pick(AREA_CODES, F.col("l_suppkey") % len(AREA_CODES)).cast("int").alias("area"),
        F.concat(F.lit("place "), (F.col("l_suppkey") % 7).cast("string")).alias("place"),
        (F.col("l_linenumber") % 2).cast("int").alias("w4p"),
        _pick(NATURE_CODES, F.col("l_partkey") % len(NATURE_CODES)).cast("int").alias("no2"),
        _pick(BODY_CODES, F.col("l_suppkey") % len(BODY_CODES)).cast("int").alias("bp2"),
        F.when(q % 2 == 0, _pick(NATURE_CODES, F.col("l_suppkey") % len(NATURE_CODES))).cast("int").alias("no3"),
        F.when(q % 2 == 0, _pick(BODY_CODES, q % len(BODY_CODES))).cast("int").alias("bp3"),
        (F.col("l_suppkey") % 3).cast("int").alias("veh"),
        F.when(F.col("l_suppkey") % 3 == 0, "driver").when(F.col("l_suppkey") % 3 == 1, "passenger").alias("veh_p"),
        (F.col("l_partkey") % 2 + 1).cast("int").alias("sub"),
        F.concat(F.lit("S"), (F.col("l_partkey") % 11).cast("string")).alias("sub_id"),
        *[_pick(SD_CODES, (F.col("l_partkey") + k) % len(SD_CODES)).cast("int").alias(f"sd{k}") for k in (3, 4, 5)],
        (q % 4 + 1).cast("int").alias("sports_code"),
        F.col("l_tax").alias("score"),
    )


CASE_VERSIONS_SQL = f"""SELECT l_orderkey AS encounter_id,
  CAST(l_linenumber AS INTEGER) AS version,
  CAST(({INTENT_CODES})[CAST(l_linenumber % {len(INTENT_CODES)} AS INTEGER) + 1] AS INTEGER) AS intent,
  CAST(({NATURE_CODES})[CAST(CAST(l_quantity AS BIGINT) % {len(NATURE_CODES)} AS INTEGER) + 1] AS INTEGER) AS no1,
  CAST(({BODY_CODES})[CAST(l_partkey % {len(BODY_CODES)} AS INTEGER) + 1] AS INTEGER) AS bp1,
  CAST(({SD_CODES})[CAST(l_suppkey % {len(SD_CODES)} AS INTEGER) + 1] AS INTEGER) AS sd1,
  CAST(({SD_CODES})[CAST((l_suppkey + CAST(l_quantity AS BIGINT)) % {len(SD_CODES)} AS INTEGER) + 1] AS INTEGER) AS sd2,
  CASE WHEN l_linestatus = 'O' THEN 'I' ELSE 'O' END AS i_o,
  CAST(l_suppkey % 9 + 1 AS INTEGER) AS disp,
  CAST(19980000 + (l_partkey % 12 + 1) * 100 + l_suppkey % 28 + 1 AS INTEGER) AS injury_date,
  CAST(CAST(l_quantity AS BIGINT) % 24 AS INTEGER) AS injury_hour, CAST(l_partkey % 60 AS INTEGER) AS injury_min,
  CASE WHEN CAST(l_quantity AS BIGINT) % 24 < 12 THEN 'a' ELSE 'p' END AS am_pm,
  CAST(({LOCATION_CODES})[CAST(l_partkey % {len(LOCATION_CODES)} AS INTEGER) + 1] AS INTEGER) AS location,
  CAST(({AREA_CODES})[CAST(l_suppkey % {len(AREA_CODES)} AS INTEGER) + 1] AS INTEGER) AS area,
  'place ' || CAST(l_suppkey % 7 AS VARCHAR) AS place, CAST(l_linenumber % 2 AS INTEGER) AS w4p,
  CAST(({NATURE_CODES})[CAST(l_partkey % {len(NATURE_CODES)} AS INTEGER) + 1] AS INTEGER) AS no2,
  CAST(({BODY_CODES})[CAST(l_suppkey % {len(BODY_CODES)} AS INTEGER) + 1] AS INTEGER) AS bp2,
  CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0
       THEN CAST(({NATURE_CODES})[CAST(l_suppkey % {len(NATURE_CODES)} AS INTEGER) + 1] AS INTEGER) END AS no3,
  CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0
       THEN CAST(({BODY_CODES})[CAST(CAST(l_quantity AS BIGINT) % {len(BODY_CODES)} AS INTEGER) + 1] AS INTEGER) END AS bp3,
  CAST(l_suppkey % 3 AS INTEGER) AS veh,
  CASE l_suppkey % 3 WHEN 0 THEN 'driver' WHEN 1 THEN 'passenger' END AS veh_p,
  CAST(l_partkey % 2 + 1 AS INTEGER) AS sub, 'S' || CAST(l_partkey % 11 AS VARCHAR) AS sub_id,
  {', '.join(f"CAST(({SD_CODES})[CAST((l_partkey + {k}) % {len(SD_CODES)} AS INTEGER) + 1] AS INTEGER) AS sd{k}" for k in (3, 4, 5))},
  CAST(CAST(l_quantity AS BIGINT) % 4 + 1 AS INTEGER) AS sports_code,
  l_tax AS score
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
             ORDER BY l_partkey, l_suppkey, l_quantity, l_linestatus, l_tax) AS rn FROM lineitem) WHERE rn = 1"""


# ---------------------------------------------------------------- vectors (embeddings)
def vectors_src(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("encounter_id"), F.col("embedding").alias("vec"))


VECTORS_SQL = "SELECT vec_id AS encounter_id, embedding AS vec FROM embeddings"


def query_vector_src(spark, d) -> DataFrame:
    """The probe vector of a semantic search: one row, taken from the data (vec_id 0)."""
    e = read(spark, d, "embeddings")
    return e.where(F.col("vec_id") == 0).select(F.col("embedding").alias("qvec"))


QUERY_VECTOR_SQL = "SELECT embedding AS qvec FROM embeddings WHERE vec_id = 0"


def with_views(sql: str, **views: str) -> str:
    """Prefix an oracle query with the fixture roles it reads, as CTEs."""
    if not views:
        return sql
    ctes = ",\n".join(f"{name} AS (\n{body}\n)" for name, body in views.items())
    return f"WITH {ctes}\n{sql}"
