"""Boosted-tree URL classifiers: on the 25 lexical features, and with SVD features added."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import finite_or_zero
from ..functions.url_features import URL_FEATURES, with_url_features
from ..session import scratch_path
from ..sources.columns import require
from .boosting import Boosting, fit_boosted
from .svd import N_COMPONENTS, SvdModel, fit_svd
from .tfidf import MAX_FEATURES, MIN_DOCUMENTS, TfidfModel, fit_tfidf

# Training settings.
TREES = 500
DEPTH = 8
STEP = 0.05
SUBSAMPLE = 0.8
SUBSAMPLE_PLUS = 0.85
COLUMN_SAMPLE = 0.8
CHILD_WEIGHT = 1.0
CHILD_WEIGHT_PLUS = 2.0
L2 = 1.0
SEED = 42


def finite_features(df: DataFrame) -> DataFrame:
    """Feature columns as doubles with infinite and missing values set to 0."""
    require(df, URL_FEATURES, "feature table")
    return df.withColumns({c: finite_or_zero(F.col(c).cast("double")) for c in URL_FEATURES})


def assemble(df: DataFrame, out: str = "features") -> DataFrame:
    """The 25 features as one vector in model order."""
    return VectorAssembler(inputCols=URL_FEATURES, outputCol=out).transform(finite_features(df))


def _settings(trees: int, depth: int, rows: float, child_weight: float) -> Boosting:
    return Boosting(trees, depth, STEP, rows, COLUMN_SAMPLE, L2, child_weight, seed=SEED)


def fit_url_model(df: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """Trees on the 25 feature columns and ``label`` of ``df``."""
    ready = finite_features(df).select(F.array(*URL_FEATURES).alias("x"), "label")
    model = fit_boosted(ready, "x", len(URL_FEATURES), settings=_settings(trees, depth, SUBSAMPLE, CHILD_WEIGHT))
    return PipelineModel([VectorAssembler(inputCols=URL_FEATURES, outputCol="features"), model])


def probability_of_phishing(scored: DataFrame, out: str = "probability") -> DataFrame:
    """ML output columns replaced by P(class 1)."""
    p = vector_to_array("probability")[1]
    return scored.withColumn("_p", p).drop("rawPrediction", "probability", "prediction", "features").withColumnRenamed(
        "_p", out
    )


def score_urls(model: PipelineModel, df: DataFrame, url: str = "url", out: str = "probability") -> DataFrame:
    """``df`` plus P(phishing) of its URL. Features and trees run in one narrow pass; a null URL scores null."""
    featured = finite_features(with_url_features(df, url))
    scored = probability_of_phishing(model.transform(featured), out).drop(*URL_FEATURES)
    return scored.withColumn(out, F.when(F.col(url).isNotNull(), F.col(out)))


def boosted_trees(model: PipelineModel) -> GBTClassificationModel:
    return next(s for s in model.stages if isinstance(s, GBTClassificationModel))


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance), most important first."""
    values = boosted_trees(model).featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(URL_FEATURES, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _saved_trees(trees: GBTClassificationModel, spark: SparkSession) -> list[tuple[np.ndarray, ...]]:
    """Each tree as arrays by node: feature (-1 in leaves), threshold, low child, high child, share of the margin."""
    path = scratch_path(spark, "trees")
    trees.write().save(path)
    found: list[list[tuple]] = [[] for _ in trees.treeWeights]
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect():
        cut = r["split"]["leftCategoriesOrThreshold"] if r["leftChild"] >= 0 else None
        feature = r["split"]["featureIndex"] if cut else -1
        value = 2 * trees.treeWeights[r["treeID"]] * r["prediction"]
        found[r["treeID"]].append((feature, cut[0] if cut else 0.0, max(r["leftChild"], 0), max(r["rightChild"], 0), value))
    return [tuple(np.array(x) for x in zip(*nodes)) for nodes in found]


def learning_curve(model: PipelineModel, train: DataFrame, val: DataFrame) -> DataFrame:
    """(round, train_log_loss, val_log_loss): the mean log-loss of the first 1, 2, … trees. Each table is read once: a task
    adds tree after tree to the margins of its rows and hands on a sum for each round."""
    spark = train.sparkSession
    trees = _saved_trees(boosted_trees(model), spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(trees)), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sign, margin, rows = 2.0 * batch.column(1).to_numpy() - 1.0, np.zeros(batch.num_rows), np.arange(batch.num_rows)
            for k, (feature, cut, low, high, value) in enumerate(trees):
                node = np.zeros(batch.num_rows, np.int64)
                going = rows if feature[0] >= 0 else rows[:0]
                while len(going):
                    at = node[going]
                    node[going] = np.where(x[going, feature[at]] <= cut[at], low[at], high[at])
                    going = going[feature[node[going]] >= 0]
                margin += value[node]
                sums[k] += np.logaddexp(0.0, -sign * margin).sum()
            n += batch.num_rows
        columns = [pa.array(np.arange(1, len(trees) + 1), pa.int32()), pa.array(sums), pa.array(np.full(len(trees), n), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["round", "loss", "n"])

    def losses(df: DataFrame, name: str) -> DataFrame:
        ready = finite_features(df).select(F.array(*URL_FEATURES).alias("x"), F.col("label").cast("double").alias("y"))
        sums = ready.mapInArrow(run, "round int, loss double, n bigint").groupBy("round")
        return sums.agg((F.sum("loss") / F.nullif(F.sum("n"), F.lit(0))).alias(name))

    rounds = spark.range(1, len(trees) + 1).select(F.col("id").cast("int").alias("round"))
    return rounds.join(losses(train, "train_log_loss"), "round", "left").join(losses(val, "val_log_loss"), "round", "left").orderBy("round")


@dataclass
class UrlPlusModel:
    """TF-IDF, SVD and trees over the 25 features followed by the SVD components."""

    tfidf: TfidfModel
    svd: SvdModel
    trees: GBTClassificationModel

    def score(
        self, df: DataFrame, key: str, url: str = "url", out: str = "probability", keep: list[str] | None = None
    ) -> DataFrame:
        """(key, kept columns, probability) for one row per key."""
        ready = plus_features(df, self.tfidf, self.svd, key, url, keep)
        return probability_of_phishing(self.trees.transform(ready), out)

    def save(self, spark: SparkSession, path: str) -> None:
        self.tfidf.save(f"{path}/tfidf")
        self.svd.save(spark, f"{path}/svd")
        self.trees.write().overwrite().save(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "UrlPlusModel":
        return cls(
            TfidfModel.load(spark, f"{path}/tfidf"),
            SvdModel.load(spark, f"{path}/svd"),
            GBTClassificationModel.load(f"{path}/trees"),
        )


def plus_features(
    df: DataFrame, tfidf: TfidfModel, svd: SvdModel, key: str, url: str = "url", keep: list[str] | None = None
) -> DataFrame:
    """(key, kept columns, features): lexical and SVD features side by side, joined by key."""
    lexical = finite_features(with_url_features(df, url)).select(
        key, *(keep or []), F.array(*URL_FEATURES).alias("_lexical")
    )
    dense = svd.transform(tfidf.weights(df, key, url)).select(key, F.col("svd").alias("_svd"))  # floats, as they move
    cells = F.concat("_lexical", F.col("_svd").cast("array<double>"))
    return lexical.join(dense, key).select(key, *(keep or []), array_to_vector(cells).alias("features"))


def fit_url_plus_model(
    train: DataFrame,
    key: str,
    url: str = "url",
    trees: int = TREES,
    depth: int = DEPTH,
    components: int = N_COMPONENTS,
    max_features: int = MAX_FEATURES,
    min_documents: int = MIN_DOCUMENTS,
) -> UrlPlusModel:
    """Fits vocabulary, SVD and trees on the training rows only."""
    tfidf = fit_tfidf(train, key, url, min_documents, max_features)
    svd = fit_svd(tfidf, tfidf.weights(train, key, url), components)
    ready = plus_features(train, tfidf, svd, key, url, keep=["label"])
    ready = ready.select(vector_to_array("features").alias("x"), "label")
    width = len(URL_FEATURES) + svd.components
    model = fit_boosted(ready, "x", width, settings=_settings(trees, depth, SUBSAMPLE_PLUS, CHILD_WEIGHT_PLUS))
    return UrlPlusModel(tfidf, svd, model)
