"""Corpus scoring with models trained in Spark (hashed terms → logistic regression): a binary
score of every text, the intent of a visit in seven classes, and the pluggable per-task model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.versions import latest_version

INTENT_CLASSES = (10, 11, 12, 13, 15, 16, 19)
INTENT_CUTOFF = 0.8
INTENT_FEATURES = 1 << 14


def score_corpus(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", num_features: int = 1 << 16) -> DataFrame:
    """Train on the labelled rows, score every row: (key, score = P(label = 1)).

    Tokenising, hashing and the regression all run as Spark ML stages; the model
    is a vector of ``num_features`` weights, independent of the corpus size.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern="[^a-z0-9]+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    lr = LogisticRegression(featuresCol="_tf", labelCol="_y", maxIter=20, regParam=0.01)
    train = docs.join(labels.select(key, F.col(label_col).cast("double").alias("_y")), key, "inner")
    model = Pipeline(stages=[tok, tf, lr]).fit(train)
    scored = model.transform(docs.select(key, text_col))
    return scored.select(key, F.round(vector_to_array("probability")[1], 6).alias("score"))


def fit_classes(rows: DataFrame, text_col: str, label_col: str, classes=INTENT_CLASSES,
                num_features: int = INTENT_FEATURES, reg: float = 1e-3, iterations: int = 100):
    """A multinomial model of ``label_col`` (one of ``classes``) by the words of ``text_col``; None without
    a row to learn from. It can be saved with ``model.write().overwrite().save(path)`` and read with
    ``load_classes``, and holds ``num_features`` weights a class, however many rows it saw.

    Rows with another label, or none, or without a word, are not learned from. A class without rows
    is never likely; where all rows have one class, it is certain."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer

    place = F.array_position(F.array(*[F.lit(c).cast("string") for c in classes]), F.col(label_col).cast("string"))
    train = (rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), (place - 1).cast("double").alias("_y"))
             .where((F.col("_y") >= 0) & F.lower("_text").rlike("[a-z0-9]")))
    if train.isEmpty():
        return None
    stages = [RegexTokenizer(inputCol="_text", outputCol="_tok", pattern="[^a-z0-9]+", toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
              LogisticRegression(featuresCol="_tf", labelCol="_y", family="multinomial", maxIter=iterations, regParam=reg,
                                 probabilityCol="_p", predictionCol="_n"),
              IndexToString(inputCol="_n", outputCol="_label", labels=[str(c) for c in classes])]
    return Pipeline(stages=stages).fit(train)


def load_classes(path: str):
    """The model that was saved at ``path``, a folder all nodes share."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def predict_classes(model, texts: DataFrame, key: str, text_col: str, cutoff: float = INTENT_CUTOFF) -> DataFrame:
    """(key, intent, probability, probabilities) of every text. ``intent`` is the likeliest class where its
    probability reaches ``cutoff``, else null; of equally likely ones the first. A text that is null
    or has no word has none of the three, and so has every text without a model."""
    from pyspark.ml.functions import vector_to_array
    rows = texts.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if model is None:
        return rows.select(key, F.lit(None).cast("int").alias("intent"), F.lit(None).cast("double").alias("probability"),
                           F.lit(None).cast("array<double>").alias("probabilities"))
    out = model.transform(rows).withColumn("_all", F.when(F.size("_tok") > 0, vector_to_array("_p")))
    top = F.array_max("_all")
    return out.select(key, F.when(top >= cutoff, F.col("_label").cast("int")).alias("intent"), top.alias("probability"),
                      F.col("_all").alias("probabilities"))


def fit_intent(tables: dict[str, DataFrame], **options):
    """The intent model of the stored tables: latest case versions as labels, narratives as texts."""
    labels = latest_version(tables["case_report"]).where(F.col("intent").isNotNull()).select("encounter_id", "intent")
    rows = tables["encounters"].select("encounter_id", "full_narrative").join(labels, "encounter_id")
    return fit_classes(rows, "full_narrative", "intent", **options)


def model_scores(df: DataFrame, load_model: Callable[[], Callable[[list[str]], list[float]]],
                 key: str, text_col: str) -> DataFrame:
    """Apply an external model through ``mapInPandas``: the model is loaded once per
    task and fed Arrow batches, never one row at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for b in batches:
            yield pd.DataFrame({key: b[key], "score": model(b[text_col].tolist())})
    return df.select(key, text_col).mapInPandas(run, schema=f"{key} long, score double")
