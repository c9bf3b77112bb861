"""Keeping the best of several candidates by validation F1."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .metrics import binary_metrics


def select_best(
    candidates: list[tuple[str, Callable[[], Any]]], predict: Callable[[Any], DataFrame], spark: SparkSession
) -> tuple[str, Any, DataFrame]:
    """Fits each candidate in turn, scores the validation rows, keeps the first with the highest F1.

    ``predict`` turns a fitted candidate into rows with ``label`` and ``predicted``. Returns the name and model
    kept, and the history as (step, name, accuracy, precision, recall, f1, kept).
    """
    best_name, best_model, best_f1, history = None, None, -1.0, []
    for step, (name, fit) in enumerate(candidates, start=1):
        model = fit()
        m = binary_metrics(predict(model)).first()
        better = m["f1"] > best_f1
        if better:
            best_name, best_model, best_f1 = name, model, m["f1"]
        history.append((step, name, m["accuracy"], m["precision"], m["recall"], m["f1"], better))
    schema = "step int, name string, accuracy double, precision double, recall double, f1 double, kept boolean"
    return best_name, best_model, spark.createDataFrame(history, schema)
