"""Labelled rows for the trained operators: which may be learned from, and a bounded, repeatable sample of them."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_is(id: str, folds: int, held: int) -> Column:
    """Whether crc32 of the id's text leaves the remainder ``held``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % folds == held, F.lit(False))


def labelled_sample(labels: DataFrame, id: str, label: str, folds: int, held: int, most: int | None) -> DataFrame:
    """(id, label, weight): at most ``most`` rows of each label 0 and 1 outside the held-out fold, drawn by a hash of the id;
    all of them if ``most`` is None.

    Labels that are null or not 0 or 1 are left out; an id that occurs again counts once, as 1 if any row says 1.
    ``weight`` is the number of labelled rows a drawn row stands for.
    """
    rows = (
        labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~fold_is(id, folds, held))
        .groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    )
    if most is None:
        return rows.withColumn("weight", F.lit(1.0))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    drawn = [
        rows.where(F.col("label") == k).orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(most)
        .withColumn("weight", F.lit(n / min(n, most))) for k, n in totals.items()
    ]
    if not drawn:
        return rows.withColumn("weight", F.lit(1.0))
    return drawn[0] if len(drawn) == 1 else drawn[0].unionByName(drawn[1])


def logit(p: float) -> float:
    return log(p / (1 - p))


def best_cut(rows: list[tuple[float, int, float]]) -> float:
    """The value that splits (value, label, weight) rows with the highest F1 of label 1; midway between its neighbours."""
    rows = sorted(rows, reverse=True)
    positives = sum(w for _, y, w in rows if y == 1)
    if not positives:
        return (rows[0][0] + 1.0) if rows else 0.0
    best, cut, hit, taken = -1.0, rows[0][0], 0.0, 0.0
    for i, (value, y, w) in enumerate(rows):
        hit, taken = hit + w * (y == 1), taken + w
        below = rows[i + 1][0] if i + 1 < len(rows) else value - 1.0
        f1 = 2 * hit / (taken + positives)
        if below < value and f1 > best:
            best, cut = f1, (value + below) / 2
    return cut
