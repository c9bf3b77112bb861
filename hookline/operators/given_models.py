"""Models as plain tables of numbers, scored inside expressions: tree ensembles as node tables, texts by word weights.

Such a model can be read, compared and joined like any table, whoever fitted it; ``TreeEnsemble.from_boosted`` turns a
fitted model into one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url_features import URL_FEATURES, with_url_features
from ..session import scratch_path
from .url_model import finite_features

NODE_SCHEMA = "tree int, node int, feature string, threshold double, low int, high int, value double"
MOST_NODES = 1 << 20


def _constant(values: Sequence, kind: str) -> Column:
    """An array literal of any length; written as JSON, which the optimiser folds to a constant."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


@dataclass(frozen=True)
class TreeEnsemble:
    """Rows (tree, node, feature, threshold, low, high, value). Node 0 is a tree's root.

    An inner node sends a row to ``low`` if its feature is at most the threshold, else, and also if it is missing, to
    ``high``; a leaf has no feature and adds its value. The probability is the logistic function of ``base`` plus the
    values of all trees.
    """

    nodes: tuple[tuple, ...]
    base: float = 0.0

    @classmethod
    def from_table(cls, nodes: DataFrame, base: float = 0.0) -> "TreeEnsemble":
        """From a node table, whose size the number and depth of the trees bound; above ``MOST_NODES`` rows it is refused."""
        rows = nodes.select("tree", "node", "feature", "threshold", "low", "high", "value").limit(MOST_NODES + 1).collect()
        if len(rows) > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes")
        return cls(tuple(sorted((tuple(r) for r in rows), key=lambda r: r[:2])), base)

    @classmethod
    def from_boosted(cls, model: GBTClassificationModel, features: Sequence[str], spark: SparkSession) -> "TreeEnsemble":
        """A fitted gradient boosted model; its probability is that of twice the weighted sum of its trees."""
        path = scratch_path(spark, "trees")
        model.write().save(path)
        saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
        weights, names = _constant(model.treeWeights, "double"), F.array(*[F.lit(f) for f in features])
        inner = F.col("leftChild") >= 0
        return cls.from_table(saved.select(
            F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(inner, F.get(names, F.col("split.featureIndex"))).alias("feature"),
            F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
            F.when(inner, F.col("leftChild")).alias("low"), F.when(inner, F.col("rightChild")).alias("high"),
            F.when(~inner, 2 * F.get(weights, F.col("treeID")) * F.col("prediction")).alias("value"),
        ))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.nodes), NODE_SCHEMA)

    def depth(self) -> int:
        """Steps from a root to the deepest leaf."""
        level = {(r[0], 0) for r in self.nodes}
        children = {(r[0], r[1]): [(r[0], r[4]), (r[0], r[5])] for r in self.nodes if r[2] is not None}
        steps = 0
        while level := {c for n in level for c in children.get(n, [])}:
            steps += 1
        return steps

    def margin(self, features: dict[str, Column]) -> Column:
        """``base`` and the value of each row's leaf in every tree, without Python and without a join."""
        place = {r[:2]: i for i, r in enumerate(self.nodes)}
        names = sorted({r[2] for r in self.nodes if r[2] is not None})
        order = {f: i for i, f in enumerate(names)}
        feature = _constant([order.get(r[2], 0) for r in self.nodes], "int")
        threshold = _constant([0.0 if r[2] is None else r[3] for r in self.nodes], "double")
        low = _constant([i if r[2] is None else place[r[0], r[4]] for i, r in enumerate(self.nodes)], "int")
        high = _constant([i if r[2] is None else place[r[0], r[5]] for i, r in enumerate(self.nodes)], "int")
        value = _constant([r[6] if r[2] is None else 0.0 for r in self.nodes], "double")
        roots = _constant(sorted(i for (_, node), i in place.items() if node == 0), "int")
        given = F.array(*[features[f].cast("double") for f in names]) if names else F.array().cast("array<double>")
        depth = self.depth()

        def leaf(x: Column, root: Column) -> Column:
            if not depth:
                return root
            step = lambda n, _: F.when(F.get(x, F.get(feature, n)) <= F.get(threshold, n), F.get(low, n)).otherwise(F.get(high, n))
            return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step)

        # The array of one element binds the features, so that they are put together once a row.
        summed = F.transform(F.array(given), lambda x: F.aggregate(roots, F.lit(float(self.base)), lambda s, root: s + F.get(value, leaf(x, root))))
        return F.get(summed, F.lit(0))

    def score_urls(self, df: DataFrame, url: str = "url", out: str = "probability") -> DataFrame:
        """``df`` plus P(phishing) of its URL by the URL features; a null URL scores null."""
        scored = finite_features(with_url_features(df, url)).withColumn(out, sigmoid(self.margin({c: F.col(c) for c in URL_FEATURES})))
        return scored.withColumn(out, F.when(F.col(url).isNotNull(), F.col(out))).drop(*URL_FEATURES)

    def score(self, df: DataFrame, key: str, url: str = "url", out: str = "probability", keep: list[str] | None = None) -> DataFrame:
        """(key, kept columns, probability)."""
        return self.score_urls(df, url, out).select(key, *(keep or []), out)


@dataclass(frozen=True)
class WordWeights:
    """P(phishing) of a text: the logistic function of ``intercept`` and the weight of each distinct word in it.

    Words are runs of letters and digits in lower case; a null text has none.
    """

    weights: dict[str, float]
    intercept: float = 0.0

    def score_text(self, df: DataFrame, text: str = "text", out: str = "text_probability") -> DataFrame:
        words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
        table = F.from_json(F.lit(json.dumps(self.weights)), "map<string,double>")
        margin = F.aggregate(words, F.lit(float(self.intercept)), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
        return df.withColumn(out, sigmoid(margin))
