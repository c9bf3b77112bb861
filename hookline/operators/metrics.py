"""Classification metrics from label, prediction and score columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import prefix_sums


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp; one row, or one per ``by`` group."""

    def cell(actual: int, guess: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(predicted) == guess))

    return df.groupBy(*(by or [])).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def binary_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Accuracy, and precision, recall, F1 of class 1. A ratio without cases is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    counts = confusion(df, label, predicted, by)
    out = counts.withColumns(
        {
            "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
        }
    )
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve; ties count half; null when one class is missing.

    Rows are first reduced to counts per distinct score. Running counts of negatives then come from a
    range-partitioned table, so neither a heavy tie nor a large score column lands in one task.
    """
    per_score = df.groupBy((F.col(score) + 0.0).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    placed = prefix_sums(per_score, "score", ["neg"])
    wins = F.col("pos").cast("decimal(19,0)") * (2 * F.col("neg_before") + F.col("neg")).cast("decimal(19,0)")
    pairs = F.col("p").cast("double") * F.col("q").cast("double")
    return (
        placed.agg(F.sum(wins).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
        .select(F.try_divide(F.col("w").cast("double") / 2.0, pairs).alias("roc_auc"))
    )


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages: five rows."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    step = confusion(df, label, predicted).withColumns(
        {
            "p0": _ratio(tn, tn + fn), "r0": _ratio(tn, tn + fp), "s0": tn + fp,
            "p1": _ratio(tp, tp + fp), "r1": _ratio(tp, tp + fn), "s1": tp + fn,
            "total": tn + fp + fn + tp, "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
        }
    ).withColumns({"f0": _f1(F.col("p0"), F.col("r0")), "f1": _f1(F.col("p1"), F.col("r1"))})

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )

    def macro(metric: str) -> Column:
        return (F.col(f"{metric}0") + F.col(f"{metric}1")) / 2

    def weighted(metric: str) -> Column:
        return _ratio(F.col(f"{metric}0") * F.col("s0") + F.col(f"{metric}1") * F.col("s1"), F.col("total"))

    accuracy, total = F.col("accuracy"), F.col("total")
    rows = F.array(
        row("LEGITIMATE", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("PHISHING", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", accuracy, accuracy, accuracy, total),
        row("macro avg", macro("p"), macro("r"), macro("f"), total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    )
    return step.select(F.explode(rows).alias("r")).select("r.*")


def log_loss(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Mean cross-entropy per row."""
    p = F.greatest(F.least(F.col(probability), F.lit(1 - 1e-15)), F.lit(1e-15))
    return df.agg(F.avg(-F.ln(F.when(F.col(label) == 1, p).otherwise(1 - p))).alias("log_loss"))


def evaluate_scores(df: DataFrame, label: str = "label", probability: str = "probability", threshold: float = 0.5) -> DataFrame:
    """One metrics record: sample count, accuracy, precision, recall, F1, ROC-AUC, confusion matrix."""
    scored = materialize(
        df.select(
            F.col(label).cast("int").alias("label"),
            F.col(probability).alias("score"),
            (F.col(probability) >= threshold).cast("int").alias("predicted"),
        ),
        "scored",
    )
    m = binary_metrics(scored).withColumn("_one", F.lit(1))
    auc = roc_auc(scored).withColumn("_one", F.lit(1))
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return m.join(auc, "_one").select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("samples"),
        "accuracy", "precision", "recall", "f1", "roc_auc", matrix.alias("confusion_matrix"),
    )


def verdict_accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy of parsed verdicts; a verdict that could not be parsed counts as an error, not as correct."""
    hit = F.col(predicted) == F.col(label)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(hit).alias("correct"),
        F.count_if(~F.coalesce(hit, F.lit(False))).alias("misclassified"),
        F.count_if(F.col(predicted).isNull()).alias("unparsed"),
        F.try_divide(F.count_if(hit).cast("double"), F.count("*")).alias("accuracy"),
    )
