"""URL filter: host/path rules first, gradient-boosted trees on lexical features elsewhere.

URLs that a rule judges are the labelled ones. The trees learn from them (length, depth,
digit ratio, character entropy, parameter counts, and the share of blocked URLs under the
host's suffix) and judge the URLs that no rule fits. Features are built-in expressions;
training and scoring are Spark's own gradient-boosted trees.

The trees are fitted on at most ``train_rows`` labelled URLs, those with the smallest hash
of the URL, in one partition so that the fit repeats exactly; the suffix statistics cover
all labelled URLs. If the rules label one class only, that class is the verdict; if they
label nothing, the verdict is ``allow``.

Defined cases: a null URL, or one without ``://``, has empty host and path, so no rule fits
and the trees judge its remaining features. Extra columns are ignored; repeated rows each
get their verdict.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.blocks import written
from caseflow.llm.text import lower_ascii

ALLOW, BLOCK = "allow", "block"
# fixed values: the rules of the query
RULES = [(ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/")]
LEXICAL = ["url_len", "host_len", "path_len", "query_len", "labels", "depth", "digit_ratio", "digits_in_host", "hyphens",
           "params", "has_fragment", "is_https", "entropy"]
FEATURES = LEXICAL + ["suffix_blocked"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(raw), path


def matching_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as text; null if none does."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        on_host = (host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))
        fits.append(F.when(on_host & F.startswith(path, F.lit(rule[at:])), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(chars, F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n == 0, 0.0).otherwise(bits)


def lexical_features(pages: DataFrame) -> DataFrame:
    """``pages`` (with url, host, path) plus the columns LEXICAL and ``suffix`` (the last host label)."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))
    host = F.col("host")
    return pages.withColumns({
        "suffix": F.regexp_extract(host, r"[^.]*$", 0),
        "url_len": F.length(url), "host_len": F.length(host), "path_len": F.length("path"), "query_len": F.length(query),
        "labels": F.size(F.split(host, r"\.")),
        "depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
        "digit_ratio": F.when(F.length(url) == 0, 0.0).otherwise(digits / F.length(url)),
        "digits_in_host": F.length(host) - F.length(F.regexp_replace(host, "[0-9]", "")),
        "hyphens": F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit(""))),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "is_https": F.startswith(lower_ascii(url), F.lit("https://")).cast("int"),
        "entropy": _entropy(url),
    })


def judge(pages: DataFrame, rules=RULES, train_rows: int = 20_000, trees: int = 12, depth: int = 4,
          key: str = "page_id") -> DataFrame:
    """key, url, host, path, rule, verdict, and ``blocked`` (the trees' probability of a block;
    null where a rule decides), one row per row of ``pages``."""
    p = pages.select(key, "url")
    host, path = split_url(F.col("url"))
    # written step by step: else each feature would repeat the expressions it is built from
    p = written(p.withColumn("host", host).withColumn("path", path), "url-parts")
    p = written(lexical_features(p.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))), "url-lexical")
    actions = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)])
    p = p.withColumn("action", F.element_at(actions, F.col("rule")))
    # share of blocked URLs under each suffix, pulled towards the overall share for rare ones
    labelled = p.where("action IS NOT NULL")
    totals = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("action") == BLOCK).cast("int")).alias("b")).first()
    n, b = totals["n"], totals["b"] or 0
    keep = [key, "url", "host", "path", "rule"]
    if b in (0, n):
        only = BLOCK if n and b else ALLOW
        return p.select(*keep, F.coalesce("action", F.lit(only)).alias("verdict"),
                        F.when(F.col("action").isNull(), float(only == BLOCK)).alias("blocked"))
    prior = b / n
    suffixes = labelled.groupBy("suffix").agg(
        ((F.sum((F.col("action") == BLOCK).cast("int")) + 20 * prior) / (F.count(F.lit(1)) + 20)).alias("suffix_blocked"))
    p = written(p.join(suffixes, "suffix", "left").withColumn("suffix_blocked", F.coalesce("suffix_blocked", F.lit(prior))),
                "url-features")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    sample = (p.where("action IS NOT NULL").withColumn("label", (F.col("action") == BLOCK).cast("double"))
              .orderBy(F.xxhash64("url"), key).limit(train_rows).select("label", *FEATURES).coalesce(1))
    model: GBTClassificationModel = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=7,
    ).fit(assemble.transform(sample))
    scored = model.transform(assemble.transform(p.where("action IS NULL")))
    judged = scored.select(*keep, F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW).alias("verdict"),
                           _second(F.col("probability")).alias("blocked"))
    ruled = p.where("action IS NOT NULL").select(*keep, F.col("action").alias("verdict"),
                                                F.lit(None).cast("double").alias("blocked"))
    return ruled.unionByName(judged)


def _second(v: Column) -> Column:
    from pyspark.ml.functions import vector_to_array
    return F.element_at(vector_to_array(v), 2)


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
