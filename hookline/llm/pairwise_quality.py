"""Document quality by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, a quantile cut."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sequence_id
from ..session import Scratch
from .frames import append_columns
from .labelled import fold_is, labelled_sample, logit

_SYMBOLS = b"#$%&*|@^~=+<>{}[]\\/_`"
_MARKS = b"!?"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"

FEATURES = (
    "words", "word_length", "symbols", "marks", "upper", "digits", "distinct", "top_word", "echo", "lines", "same_lines",
    "stops", "many_symbols", "many_marks", "much_upper", "much_echo", "one_word", "few_words", "ends",
)


def features(text: str | None) -> list[float]:
    """How a text is written, as numbers of about 0 to 1 in the order of ``FEATURES``. Null counts as empty."""
    text = text or ""
    raw = text.encode()
    tokens = text.split()
    n, size = max(1, len(tokens)), max(1, len(raw))
    share = {k: (len(raw) - len(raw.translate(None, c))) for k, c in (("s", _SYMBOLS), ("m", _MARKS), ("u", _UPPER), ("d", _DIGITS), ("p", b".,;:"))}
    counts = Counter(tokens)
    top = max(counts.values(), default=0) / n
    echo = sum(map(str.__eq__, tokens, tokens[1:])) / n
    lines = text.split("\n")
    per_word = {k: v / n for k, v in share.items()}
    upper = share["u"] / size
    return [
        min(1.0, math.log1p(len(tokens)) / 10), min(2.0, len(text) / n / 10), min(2.0, per_word["s"]), min(2.0, per_word["m"]),
        upper, min(1.0, share["d"] / size), len(counts) / n, top, echo, min(1.0, len(lines) / n), 1 - len(set(lines)) / len(lines),
        min(1.0, per_word["p"]), min(1.0, per_word["s"] / 0.2), min(1.0, per_word["m"] / 0.2), min(1.0, upper / 0.2), min(1.0, echo / 0.1),
        min(1.0, top / 0.25), max(0.0, 1 - len(tokens) / 50), float(text[-1:] in (".", "!", "?")),
    ]


def with_features(docs: DataFrame, text: str = "text", out: str = "x") -> DataFrame:
    """``docs`` with the array of ``FEATURES`` of each whole text; a column named ``out`` is replaced."""

    def make(texts):
        return [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    return append_columns(docs, text, {out: "array<double>"}, make)


@dataclass(frozen=True)
class Ranker:
    """Weights of the features and the value at the cut."""

    weights: tuple[float, ...]
    cut: float

    def value(self, x: str = "x"):
        return sum((F.col(x)[i] * F.lit(w) for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, x: str = "x"):
        """P(label 1) as a column: the chance to be preferred to the document at the cut, moved so that the cut is at 0.7."""
        return 1 / (1 + F.exp(-(self.value(x) - F.lit(self.cut) + F.lit(logit(0.7)))))


def fit_ranker(
    rows: DataFrame, labels: DataFrame, scratch: Scratch, id: str = "doc_id", x: str = "x", label: str = "quality",
    folds: int = 4, held: int = 2, rivals: int = 8, penalty: float = 1e-5,
) -> Ranker:
    """The ranker learned from ``rows`` (id and features) with all labelled rows outside the held-out fold.

    Every row of the rarer label meets about ``rivals`` times as many pairs as there are rows of the commoner one
    over the rarer one would give one by one: rows are dealt to slots by hash and pairs are formed within a slot only.
    A pair is the difference of features of the preferred and the other document; logistic regression without
    intercept on differences of both signs is the Bradley-Terry likelihood. The cut is the exact quantile of the labelled rows' scores
    that leaves the share of label 1 above it. With one label only nothing can be learned and all scores are 0.7 or
    just below, as that label says; without labels they are just below.
    """
    labelled = labelled_sample(labels, id, label, folds, held, None).drop("weight")
    learned = scratch.table(rows.select(F.col(id).alias("id"), F.col(x).alias("x")).join(labelled, "id"))
    sizes = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Ranker((0.0,) * len(FEATURES), -1e-6 if 1 in sizes else 1e-6)
    slots = max(1, math.ceil(max(sizes.values()) / rivals))
    salt = F.explode(F.sequence(F.lit(0), F.lit(rivals - 1)))
    good = learned.where("label = 1").select("x", F.col("id").alias("i"), salt.alias("r"))
    good = good.select("x", F.pmod(F.xxhash64("i", "r"), F.lit(slots)).alias("slot"))
    bad = learned.where("label = 0").select(F.col("x").alias("y"), F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(slots)).alias("slot"))
    gap = F.zip_with("x", "y", lambda a, b: a - b)
    pairs = scratch.table(good.join(bad, "slot").select(gap.alias("d")))
    if pairs.isEmpty():
        return Ranker((0.0,) * len(FEATURES), 1e-6)
    both = pairs.select(array_to_vector("d").alias("d"), F.lit(1).alias("label")).unionByName(
        pairs.select(array_to_vector(F.transform("d", lambda v: -v)).alias("d"), F.lit(0).alias("label"))
    )
    model = LogisticRegression(featuresCol="d", labelCol="label", fitIntercept=False, regParam=penalty, maxIter=60).fit(both)
    weights = np.array(model.coefficients.toArray())
    ranker = Ranker(tuple(float(w) for w in weights), 0.0)
    placed = sequence_id(learned.select((-ranker.value()).alias("low")), ["low"], "place")
    edge = [-r["low"] for r in placed.where(F.col("place").isin(sizes[1], sizes[1] + 1)).orderBy("place").collect()]
    return Ranker(ranker.weights, sum(edge) / len(edge))


def score_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    Only the text enters a score. Null and empty texts are scored by their features like others; repeated rows get equal
    scores; other columns are not read; an empty table stays empty. Texts are read once, their features written out.
    """
    rows = scratch.table(with_features(docs.select(F.col(id).alias("id"), F.col(text).alias("text"))).select("id", "x"))
    label = settings.get("label", "quality")
    ranker = fit_ranker(rows, labels.select(F.col(id).alias("id"), F.col(label)), scratch, "id", "x", **settings)
    folds, held = settings.get("folds", 4), settings.get("held", 2)
    scored = rows.select(F.col("id").alias(id), fold_is("id", folds, held).alias("held_out"), ranker.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
