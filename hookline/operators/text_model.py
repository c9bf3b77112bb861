"""Text classifier: words, hashed counts, IDF, logistic regression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import materialize

HASH_SIZE = 1 << 18
BATCH_SIZE = 4  # fixed value: texts per call of an outside model


def _counting(text: str, hash_size: int) -> PipelineModel:
    return PipelineModel([
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=hash_size),
    ])


def count_words(df: DataFrame, text: str = "text", hash_size: int = HASH_SIZE) -> DataFrame:
    """(_counts, label) of the training rows, written: a fit reads them three times, and texts are slow to cut into words."""
    rows = df.select(text, F.col("label").cast("double").alias("label"))
    return materialize(_counting(text, hash_size).transform(rows).select("_counts", "label"), "text-counts")


def fit_text_model(
    df: DataFrame, text: str = "text", hash_size: int = HASH_SIZE, reg: float = 1e-3, iterations: int = 50, counted: DataFrame | None = None
) -> PipelineModel:
    """Pipeline from a text column to class probabilities, fitted on ``text`` and ``label``.

    Hashed counts need no vocabulary on the driver; the regression aggregates gradients in a tree. ``counted``, the
    result of ``count_words`` for the same rows, serves several fits.
    """
    counted = count_words(df, text, hash_size) if counted is None else counted
    idf = IDF(inputCol="_counts", outputCol="_weighted").fit(counted)
    regression = LogisticRegression(featuresCol="_weighted", labelCol="label", regParam=reg, maxIter=iterations)
    return PipelineModel([*_counting(text, hash_size).stages, idf, regression.fit(idf.transform(counted))])


def score_text(model: PipelineModel, df: DataFrame, text: str = "text", out: str = "text_probability") -> DataFrame:
    """``df`` plus P(phishing) of its text. ``df`` must not have columns named like the pipeline's own."""
    source = model.stages[0].getInputCol()
    ready = df if source == text else df.withColumn(source, F.col(text))
    scored = model.transform(ready).withColumn("_p", vector_to_array("probability")[1])
    extra = [] if source == text or source in df.columns else [source]
    return scored.drop(
        "_words", "_counts", "_weighted", "rawPrediction", "probability", "prediction", *extra
    ).withColumnRenamed("_p", out)


def score_text_with(
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    df: DataFrame,
    text: str = "text",
    out: str = "text_probability",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """The same interface for a model of the caller's: ``make_predict`` runs once per Python worker and returns a
    function from an array of texts to an array of P(phishing)."""
    predict = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)
    return df.withColumn(out, predict(text))
