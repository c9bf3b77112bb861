"""Late fusion: logistic regression on text probability, URL probability and URL count."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Inputs and settings.
FUSION_FEATURES = ["text_probability", "url_probability", "url_count"]
INVERSE_PENALTY = 1.0
MAX_ITERATIONS = 1000


def scaling_stages(n_rows: int, inputs: list[str] = FUSION_FEATURES) -> list:
    """Stages that standardise by mean and population deviation.

    ``StandardScaler`` divides by the sample deviation (n - 1); the last stage corrects for that.
    """
    correction = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    return [
        VectorAssembler(inputCols=inputs, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_standard", withMean=True, withStd=True),
        ElementwiseProduct(
            scalingVec=Vectors.dense([correction] * len(inputs)), inputCol="_standard", outputCol="features"
        ),
    ]


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """``df`` plus the class weight n / (classes * n_class). Two counts reach the plan as constants."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).limit(3).collect()}
    if len(counts) > 2:
        raise ValueError(f"{label} has more than two values")
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn(out, weight)


def fit_fusion_model(df: DataFrame, label: str = "label") -> PipelineModel:
    """Scaler and balanced, L2-penalised logistic regression."""
    n_rows = df.count()
    weighted = balanced_weights(df.withColumn("_label", F.col(label).cast("double")), "_label", "_weight")
    regression = LogisticRegression(
        featuresCol="features", labelCol="_label", weightCol="_weight", maxIter=MAX_ITERATIONS, tol=1e-9,
        standardization=False, elasticNetParam=0.0, regParam=1.0 / (INVERSE_PENALTY * n_rows),
    )
    return Pipeline(stages=[*scaling_stages(n_rows), regression]).fit(weighted)


def score_fusion(model: PipelineModel, df: DataFrame, out: str = "fused_probability") -> DataFrame:
    scored = model.transform(df).withColumn("_p", vector_to_array("probability")[1])
    return scored.drop(
        "_raw", "_standard", "features", "rawPrediction", "probability", "prediction"
    ).withColumnRenamed("_p", out)


def fusion_coefficients(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, coefficient) on the standardised inputs, with the intercept as its own row."""
    regression = model.stages[-1]
    rows = [(f, float(c)) for f, c in zip(FUSION_FEATURES, regression.coefficients)]
    rows.append(("intercept", float(regression.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")
