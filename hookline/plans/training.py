"""Training runs: split, fit, evaluate, and the metrics record that goes with the model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion_model as FM
from ..operators import metrics as M
from ..operators import text_model as TM
from ..operators import url_model as UM
from ..operators.splits import stratified_split
from ..session import materialize


def _part(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def _sample_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_samples") for s in ("train", "val", "test")]
    )


def _record(model: str, counts: DataFrame, evaluated: dict[str, DataFrame], extra: dict[str, dict[str, float]]) -> DataFrame:
    """One row: model name, sample counts, a struct of metrics for each evaluated split, maps of named numbers."""
    out = counts.withColumn("_one", F.lit(1))
    for name, table in evaluated.items():
        out = out.join(table.select(F.lit(1).alias("_one"), F.struct("*").alias(name)), "_one")
    maps = {
        name: F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) for name, values in extra.items()
    }
    return out.drop("_one").withColumns({"model": F.lit(model), **maps})


def _named(table: DataFrame, name: str, value: str) -> dict[str, float]:
    return {r[name]: r[value] for r in table.collect()}  # one entry per model feature


def train_url_model(
    features: DataFrame, key: str, trees: int = UM.TREES, depth: int = UM.DEPTH
) -> tuple[PipelineModel, DataFrame]:
    """Trees on a table of (key, 25 features, label), split 70 / 10 / 20, with test metrics and importances."""
    rows = materialize(stratified_split(features, "70_10_20", key=key), "url-training")
    model = UM.fit_url_model(_part(rows, "train"), trees, depth)
    scored = UM.probability_of_phishing(model.transform(UM.finite_features(_part(rows, "test"))))
    importance = _named(UM.feature_importance(model, rows.sparkSession), "feature", "importance")
    record = _record(
        "boosted trees", _sample_counts(rows), {"test": M.evaluate_scores(scored)}, {"feature_importance": importance}
    )
    return model, record


def train_url_plus_model(urls: DataFrame, key: str, url: str = "url", **sizes) -> tuple[UM.UrlPlusModel, DataFrame]:
    """The model with SVD features on a table that already has its (domain-disjoint) ``split``."""
    rows = materialize(urls.select(key, url, "label", "split"), "url-plus-training")
    model = UM.fit_url_plus_model(_part(rows, "train"), key, url, **sizes)
    scored = model.score(_part(rows, "test"), key, url, keep=["label"])
    return model, _record("boosted trees with SVD features", _sample_counts(rows), {"test": M.evaluate_scores(scored)}, {})


def train_text_model(dataset: DataFrame, text: str = "text", **settings) -> tuple[PipelineModel, DataFrame]:
    """The text model on a table with its ``split``, with validation and test metrics."""
    model = TM.fit_text_model(_part(dataset, "train"), text, **settings)
    scored = materialize(TM.score_text(model, dataset, text).select("label", "split", "text_probability"), "text-eval")
    evaluated = {s: M.evaluate_scores(_part(scored, s), probability="text_probability") for s in ("val", "test")}
    return model, _record("text", _sample_counts(scored), evaluated, {})


def train_fusion_model(scored: DataFrame, key: str = "id") -> tuple[PipelineModel, DataFrame]:
    """Late fusion on (key, label, text_probability, url_probability, url_count), split 70 / 15 / 15, with
    validation and test metrics and coefficients. Pass rows the text model was not fitted on."""
    rows = materialize(stratified_split(scored, "70_15_15", key=key), "fusion-training")
    model = FM.fit_fusion_model(_part(rows, "train"))
    fused = FM.score_fusion(model, rows)
    evaluated = {s: M.evaluate_scores(_part(fused, s), probability="fused_probability") for s in ("val", "test")}
    coefficients = _named(FM.fusion_coefficients(model, rows.sparkSession), "feature", "coefficient")
    return model, _record("logistic late fusion", _sample_counts(rows), evaluated, {"coefficients": coefficients})
